"""Rules, profiles, features, models, governance and monitoring over DataFrames."""
