"""Personal data by patterns, checksums and context words, in Spark SQL functions only.

A pattern proposes spans; splitting the text at it and extracting what it
matches gives the gaps and the matches, and their lengths give the positions.
Rules on the digits (parts of an address, Luhn, mod 97) confirm a proposal.
Each kind starts from a score of its own, and a context word in the characters
around a span raises it. Four kinds are always reported when confirmed; the
others only from a least score on.

The patterns match what their plain forms match, leftmost and not overlapping,
but never go back over a run of characters twice: possessive repeats, and
starts only where a run starts or the last match ended. Only account codes go
back, by at most 34 characters for each length that their country may have.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeworks.llm.base import spans_text, table

_LOCAL = "A-Za-z0-9._%+-"
_PART = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
NEAR = 40
#: No match is shorter than four characters, so those within NEAR of a span are among so many on each side.
_BESIDE = -(-NEAR // 4)
LEAST_SCORE = 0.6
_STEP = 64


# Characters of an account code by country.
_ACCOUNT_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FO GL NL", 19: "MK SI", 20: "AT BA EE KZ LT LU XK", 21: "CH HR LI LV",
    22: "BG BH CR DE GB GE IE ME RS", 23: "AE GI IL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "PT", 26: "IS TR",
    27: "FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HU LB PL", 29: "BR EG PS QA UA", 30: "JO KW MU", 31: "MT",
}


def _account() -> str:
    """An account code, as long as its country has it where that fits, so that the next word is no part of it."""
    known = [
        rf"(?:{names.replace(' ', '|')})[0-9]{{2}}(?:\x20?[A-Z0-9]){{{size - 4}}}(?![A-Za-z0-9])" for size, names in _ACCOUNT_LENGTHS.items()
    ]
    return "|".join([*known, r"[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}(?![A-Za-z0-9])"])


@dataclass(frozen=True)
class Kind:
    name: str
    pattern: str
    #: A cheap condition without which nothing matches.
    needs: str
    score: float
    context: str
    always: bool


KINDS = (
    Kind("email", rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@", 0.9, "mail|contact|write", True),
    Kind("ip", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", ".", 0.6, r"\bip\b|address|host|server|login", True),
    Kind("card", r"[0-9](?:[\x20-]?[0-9]){12,}+", "", 0.7, "card|visa|master|credit|debit|payment|konto|carte|tarjeta", True),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", "+", 0.7, "phone|tel|call|mobile|fax|whatsapp", True),
    Kind("iban", f"(?<![A-Za-z0-9])(?:{_account()})", "", 0.8, "iban|account|bank|konto", False),
    Kind("ssn", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", "-", 0.4, r"\bssn\b|social|security|insurance", False),
)


def luhn(number: Column) -> Column:
    """Whether a string of digits passes Luhn's check."""
    back = F.reverse(number)

    def weight(total: Column, k: Column) -> Column:
        digit = F.substr(back, k, F.lit(1)).cast("int")
        doubled = F.when(digit > 4, 2 * digit - 9).otherwise(2 * digit)
        return total + F.when(k % 2 == 0, doubled).otherwise(digit)

    return F.aggregate(F.sequence(F.lit(1), F.length(number)), F.lit(0), weight) % 10 == 0


def mod97(code: Column) -> Column:
    """Whether an account code of capitals and digits leaves 1 modulo 97, its first four characters moved to the end."""
    turned = F.concat(F.substr(code, F.lit(5)), F.substr(code, F.lit(1), F.lit(4)))

    def digits(rest: Column, k: Column) -> Column:
        value = F.ascii(F.substr(turned, k, F.lit(1)))
        return F.when(value < 65, rest * 10 + value - 48).otherwise(rest * 100 + value - 55) % 97

    return F.aggregate(F.sequence(F.lit(1), F.length(turned)), F.lit(0), digits) == 1


def confirmed(kind: str, match: Column) -> Column:
    bare = F.translate(match, " ().-+", "")
    size = F.length(bare)
    if kind == "ip":
        return match.rlike(rf"^{_PART}(?:\.{_PART}){{3}}$")
    if kind == "card":
        return F.when(size.between(13, 19), luhn(bare)).otherwise(False)
    if kind == "phone":
        return size.between(9, 15)
    if kind == "iban":
        return F.when(size.between(15, 34), mod97(bare)).otherwise(False)
    return F.lit(True)


def _sum(parts: Column) -> Column:
    return F.aggregate(parts, F.lit(0), lambda total, p: total + p["gap"] + p["size"])


def _near(parts: Column) -> Column:
    """Parts with the characters around each match, neighbouring matches among them.

    `back` ends and `ahead` begins what a part holds, its gap before and after; where that is NEAR long, it is enough.
    """

    def one(p: Column, k: Column) -> Column:
        first = F.greatest(k - _BESIDE + 1, F.lit(1))
        before = F.array_join(F.transform(F.slice(parts, first, k - first + 1), lambda x: x["back"]), "")
        after = F.array_join(F.transform(F.slice(parts, k + 2, F.lit(_BESIDE)), lambda x: x["ahead"]), "")
        left = F.when(F.length(p["before"]) < NEAR, F.right(F.concat(before, p["before"]), F.lit(NEAR))).otherwise(p["before"])
        right = F.when(F.length(p["after"]) < NEAR, F.left(F.concat(p["after"], after), F.lit(NEAR))).otherwise(p["after"])
        return F.struct(p["gap"].alias("gap"), p["size"].alias("size"), p["match"].alias("match"), F.lower(F.concat_ws(" ", left, right)).alias("near"))

    return F.transform(parts, one)


def _placed(parts: Column) -> Column:
    """Start and end of each match from the lengths of gaps and matches.

    Sums are taken in steps of a fixed number of parts, so that a text of very many matches stays cheap.
    """
    steps = F.sequence(F.lit(0), F.floor((F.size(parts) - 1) / _STEP).cast("int"))
    part = lambda s: F.slice(parts, s * _STEP + 1, F.lit(_STEP))
    # One running sum over the steps; as an argument of zip_with it is taken once, not for each step again.
    sums = F.aggregate(steps, F.array(F.lit(0)), lambda done, s: F.concat(done, F.array(F.element_at(done, -1) + _sum(part(s)))))

    def one(s: Column, before: Column) -> Column:
        return F.transform(
            part(s),
            lambda p, k: F.struct(
                (before + _sum(F.slice(part(s), F.lit(1), k)) + p["gap"]).alias("start"), p["size"].alias("size"),
                p["match"].alias("match"), p["near"].alias("near"),
            ),
        )

    none = F.lit(None).cast("array<struct<start:int,size:int,match:string,near:string>>")
    return F.coalesce(F.when(F.size(parts) > 0, F.flatten(F.zip_with(steps, F.slice(sums, F.lit(1), F.size(steps)), one))).otherwise(none), F.array())


def spans(docs: DataFrame, key: str = "doc_id", text: str = "text", least: float = LEAST_SCORE) -> DataFrame:
    """Key and spans (kind, start, end, score) of each row of `docs`, by kind as listed, then start.

    Positions count code points, ends are exclusive. Null and empty texts have no
    spans. Repeated rows come out as often as they went in; a null key stays
    null; other columns are not read.
    """
    rows = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    possible = lambda k: F.col("text").contains(k.needs) if k.needs else F.lit(True)
    rows = rows.withColumns({f"gaps_{k.name}": F.when(possible(k), F.split("text", k.pattern, -1)) for k in KINDS})
    hit = lambda k: F.size(f"gaps_{k.name}") > 1
    rows = rows.withColumns(
        {f"found_{k.name}": F.when(hit(k), F.regexp_extract_all("text", F.lit(k.pattern), F.lit(0))) for k in KINDS}
    )

    def parts(k: Kind) -> Column:
        gaps, found = F.col(f"gaps_{k.name}"), F.col(f"found_{k.name}")
        after = F.slice(gaps, F.lit(2), F.size(found))
        last, first = lambda x: F.right(x, F.lit(NEAR)), lambda x: F.left(x, F.lit(NEAR))
        return F.transform(
            F.arrays_zip(F.slice(gaps, F.lit(1), F.size(found)).alias("g"), found.alias("m"), after.alias("a")),
            lambda z: F.struct(
                F.length(z["g"]).alias("gap"), F.length(z["m"]).alias("size"), z["m"].alias("match"),
                last(z["g"]).alias("before"), first(z["a"]).alias("after"),
                last(F.concat(last(z["g"]), last(z["m"]))).alias("back"), first(F.concat(first(z["m"]), first(z["a"]))).alias("ahead"),
            ),
        )

    rows = rows.select("key", *[F.when(F.col(f"found_{k.name}").isNotNull(), parts(k)).alias(f"parts_{k.name}") for k in KINDS])
    rows = rows.select("key", *[_near(F.col(f"parts_{k.name}")).alias(f"parts_{k.name}") for k in KINDS])
    rows = rows.select("key", *[_placed(F.col(f"parts_{k.name}")).alias(f"placed_{k.name}") for k in KINDS])

    def scored(k: Kind) -> Column:
        good = F.filter(f"placed_{k.name}", lambda p: confirmed(k.name, p["match"]))
        score = lambda p: F.when(p["near"].rlike(k.context), min(1.0, k.score + 0.3)).otherwise(k.score)
        made = F.transform(
            good,
            lambda p: F.struct(F.lit(k.name).alias("kind"), p["start"].alias("start"), (p["start"] + p["size"]).alias("end"), score(p).alias("score")),
        )
        return made if k.always else F.filter(made, lambda s: s["score"] >= least)

    return rows.select(F.col("key").alias(key), F.concat(*[scored(k) for k in KINDS]).alias("spans"))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = [k.name for k in KINDS if k.always]

    def only(*kinds: str) -> Column:
        return F.filter("spans", lambda s: s["kind"].isin(*kinds))

    return spans(table(spark, sf_dir, "documents")).select(
        "doc_id",
        *[F.size(only(name)).cast("long").alias(f"n_{name}") for name in base],
        F.sha2(spans_text(only(*base)), 256).alias("base_sha256"),
        spans_text(F.col("spans")).alias("spans"),
    )


# Fixed values for DuckDB: the plain patterns, of which those above are forms that never go back.
_PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+",
    "card": r"[0-9](?:[ -]?[0-9])+",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
    "iban": rf"\b(?:{_account()})".replace("(?![A-Za-z0-9])", r"\b"),
    "ssn": r"\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b",
}
_VALID = {
    "email": "TRUE",
    "ip": "len(list_filter(string_split(m, '.'), lambda p: CAST(p AS HUGEINT) > 255)) = 0",
    "card": """len(bare) BETWEEN 13 AND 19 AND list_sum(list_transform(range(1, len(bare) + 1), lambda k:
      CASE WHEN k % 2 = 1 THEN CAST(substr(reverse(bare), k, 1) AS INTEGER)
      ELSE CAST(substr(reverse(bare), k, 1) AS INTEGER) * 2
        - CASE WHEN CAST(substr(reverse(bare), k, 1) AS INTEGER) > 4 THEN 9 ELSE 0 END END)) % 10 = 0""",
    "phone": "len(bare) BETWEEN 9 AND 15",
    "iban": """len(bare) BETWEEN 15 AND 34 AND list_reduce(list_prepend(CAST(0 AS BIGINT), list_transform(string_split(array_to_string(list_transform(
        string_split(substr(bare, 5) || substr(bare, 1, 4), ''),
        lambda c: CASE WHEN c BETWEEN '0' AND '9' THEN c ELSE CAST(ascii(c) - 55 AS VARCHAR) END), ''), ''),
        lambda c: CAST(c AS BIGINT))), lambda a, c: (a * 10 + c) % 97) = 1""",
    "ssn": "regexp_matches(lower(right(before, 40) || ' ' || left(after, 40)), '\\bssn\\b|social|security|insurance')",
}


def _kind_sql(number: int, name: str) -> str:
    """(doc_id, kind number, start, end) of one kind's confirmed matches."""
    return f"""
  SELECT doc_id, {number} AS kind, start, start + len(m) AS stop FROM (
    SELECT doc_id, m, before, after, translate(m, ' ().-+', '') AS bare, start FROM (
      SELECT doc_id, found[i] AS m, gaps[i] AS before, gaps[i + 1] AS after,
        CAST(len(gaps[i]) + COALESCE(list_sum(list_transform(range(1, i), lambda j: len(gaps[j]) + len(found[j]))), 0) AS BIGINT) AS start
      FROM (SELECT doc_id, gaps, found, unnest(range(1, len(found) + 1)) AS i FROM (
        SELECT doc_id, regexp_extract_all(text, '{_PLAIN[name]}') AS found, string_split_regex(text, '{_PLAIN[name]}') AS gaps
        FROM documents WHERE text IS NOT NULL) a) b) c) d
  WHERE {_VALID[name]}"""


_NAMES = [k.name for k in KINDS]
_JOINED = "COALESCE(string_agg({names}[kind] || ':' || start || ':' || stop, ',' ORDER BY kind, start) {only}, '')"
ORACLES = {
    "op10_pii": f"""
WITH s AS ({' UNION ALL '.join(_kind_sql(n, name) for n, name in enumerate(_NAMES, 1))})
SELECT d.doc_id, {', '.join(f"COUNT(kind) FILTER (WHERE kind = {n}) AS n_{name}" for n, name in enumerate(_NAMES[:4], 1))},
  sha256({_JOINED.format(names=_NAMES, only="FILTER (WHERE kind <= 4)")}) AS base_sha256,
  {_JOINED.format(names=_NAMES, only="")} AS spans
FROM (SELECT doc_id FROM documents) d LEFT JOIN s ON s.doc_id = d.doc_id GROUP BY d.doc_id
"""
}
QUERIES = {"op10_pii": op10_pii}
