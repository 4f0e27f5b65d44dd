"""The few errors a caller may want to catch."""


class GaugeError(Exception):
    """Base of every error raised on purpose by this package."""


class SourceError(GaugeError):
    """A source could not be read, or was asked for in a way that is not allowed."""


class SinkError(GaugeError):
    """A write was refused or failed."""


class EmptyInputError(GaugeError):
    """An operation that needs rows was given none."""


class SchemaError(GaugeError):
    """A column is missing or has another type than expected."""


class ConfigError(GaugeError):
    """A parameter has a value that makes no sense."""


class FeatureError(GaugeError):
    """A feature table or feature stage cannot be built or found."""


class QualityGateError(GaugeError):
    """Blocking data-quality rules failed."""

    def __init__(self, message, failed_rules):
        super().__init__(message)
        self.failed_rules = list(failed_rules)


class EvaluationError(GaugeError):
    """A model cannot be evaluated on this input."""


class ScoringError(GaugeError):
    """A batch cannot be scored."""


class RegistryError(GaugeError):
    """A model version or alias does not exist."""


class NotApprovedError(GaugeError):
    """A challenger did not pass its technical gates."""
