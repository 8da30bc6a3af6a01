"""Secret scans: three fixed patterns, and character Markov models for what the patterns miss.

Two first-order character models are trained, one on random strings and one on ordinary identifiers. A run of
token characters that overlaps no pattern span is scored by the log-likelihood ratio of the two; a run is a
secret of kind ``markov`` if the ratio is at least ``min_ratio`` in all and ``min_mean`` a character.

The labelled samples come from the documents: random strings are the values that the patterns find, in about
``RANDOM_DOCS`` documents, identifiers are the other runs of ``MIN_IDENTIFIER`` or more characters, in about
``PLAIN_DOCS`` documents; both are chosen by a hash of the row. Of small tables all rows are taken. Pseudo-counts
stand for what a sample lacks: even ones for random strings, the usual characters for identifiers.

All of it is DataFrame functions. Positions are code points, ends exclusive: the parts between the matches
(``split``) and the matches (``regexp_extract_all``) have lengths that add up to them.

Defined cases: a null or empty text has no spans; repeated rows are scanned one by one; a text of any length is
scanned whole; other columns are untouched, and helper columns take free names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tallyframe.llm.common import free_name

#: The patterns and the least length that a match must have.
ASSIGN = r"""(?i:(?=[psta])(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"  # 20 characters or more; a shorter run holds no longer one
HEX = r"[0-9a-f]{24,}"
MIN_VALUE = 6
KINDS = ("assign", "access", "hex", "markov")

RUN = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}"
IDENTIFIER = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{6,}"
MIN_IDENTIFIER = 6
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-"
SIZE = len(ALPHABET) + 1  # place 0 is any other character
RANDOM_DOCS, PLAIN_DOCS = 40_000, 4_000
RANDOM_PSEUDO, PLAIN_PSEUDO = 2.0, 0.5

_SPANS = "array<struct<start:int,kind:int,end:int>>"


def matches(text: Column, pattern: str) -> Column:
    """``array<struct<start, found>>`` of the leftmost non-overlapping matches; texts without one are only searched."""
    parts = F.split(text, pattern, -1)
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,found:string>>").alias("out"))

    def step(acc: Column, pair: Column) -> Column:
        here = acc["at"] + F.length(pair["part"])
        return F.struct(
            (here + F.coalesce(F.length(pair["found"]), F.lit(0))).alias("at"),
            F.when(pair["found"].isNull(), acc["out"]).otherwise(F.concat(acc["out"], F.array(F.struct(here.alias("start"), pair["found"].alias("found"))))).alias("out"),
        )

    located = F.aggregate(F.arrays_zip(parts.alias("part"), found.alias("found")), start, step, lambda acc: acc["out"])
    return F.when(text.rlike(pattern), located).otherwise(start["out"])


def _spans(found: Column, kind: str) -> Column:
    return F.transform(found, lambda m: F.struct(m["start"].alias("start"), F.lit(KINDS.index(kind)).alias("kind"), (m["start"] + F.length(m["found"])).alias("end")))


def base_spans(text: Column) -> Column:
    """``array<struct<start, kind, end>>`` of the fixed patterns, by start and kind."""
    assigned = F.filter(matches(text, ASSIGN), lambda m: F.length(F.regexp_extract(m["found"], ASSIGN, 2)) >= MIN_VALUE)
    return F.array_sort(F.concat(_spans(assigned, "assign"), _spans(matches(text, ACCESS), "access"), _spans(matches(text, HEX), "hex")))


def train(docs: DataFrame, text_col: str = "text") -> list[float]:
    """Log-likelihood ratios of all pairs of characters, ``SIZE`` by ``SIZE``; only pair counts reach the driver."""
    rows = docs.count()
    chance = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c, t in docs.dtypes if not t.startswith("map")]), F.lit(1_000_000))
    chosen = docs.select(chance.alias("chance"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))
    some = lambda n: chosen.where(F.col("chance") < int(1_000_000 * min(1.0, n / max(rows, 1))))
    value = F.transform(matches(F.col("text"), ASSIGN), lambda m: F.regexp_extract(m["found"], ASSIGN, 2))
    plain = lambda p: F.regexp_extract_all("text", F.lit(p), F.lit(0))
    values = some(RANDOM_DOCS).select(F.explode(F.filter(F.concat(value, plain(ACCESS), plain(HEX)), lambda v: F.length(v) >= 20)).alias("run"))
    rest = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.col("text"), ASSIGN, " "), ACCESS, " "), HEX, " ")
    names = some(PLAIN_DOCS).select(F.explode(F.regexp_extract_all(rest, F.lit(IDENTIFIER), F.lit(0))).alias("run"))
    random, ordinary = _pairs(values), _pairs(names)
    return _ratios(random, ordinary)


def _pairs(runs: DataFrame) -> dict[str, int]:
    """How often each pair of neighbours stands in distinct runs (copies of a text add nothing)."""
    pair = F.explode(F.transform(F.sequence(F.lit(1), F.length("run") - 1), lambda i: F.substr("run", i, F.lit(2))))
    return {r["pair"]: r["count"] for r in runs.distinct().select(pair.alias("pair")).groupBy("pair").count().collect()}


def _ratios(random: dict[str, int], ordinary: dict[str, int]) -> list[float]:
    import numpy as np

    def counted(pairs: dict[str, int]) -> np.ndarray:
        m = np.zeros((SIZE, SIZE))
        for pair, n in pairs.items():
            m[ALPHABET.find(pair[0]) + 1, ALPHABET.find(pair[1]) + 1] += n
        return m

    def model(m: np.ndarray, pseudo: float, backoff: np.ndarray) -> np.ndarray:
        m = m + pseudo * SIZE * backoff
        return np.log(m / m.sum(axis=1, keepdims=True))

    even = np.full(SIZE, 1 / SIZE)
    names = counted(ordinary)
    usual = names.sum(axis=0)
    usual = 0.9 * usual / usual.sum() + 0.1 * even if usual.sum() else even
    return (model(counted(random), RANDOM_PSEUDO, even) - model(names, PLAIN_PSEUDO, usual)).ravel().round(6).tolist()


def markov_spans(text: Column, ratios: list[float], base: Column, min_ratio: float = 10.0, min_mean: float = 0.6) -> Column:
    """Spans of kind ``markov``: random-looking runs that overlap no span of ``base``."""
    table = F.split(F.lit(",".join(map(str, ratios))), ",").cast("array<double>")  # a constant, folded once
    place = lambda c: F.instr(F.lit(ALPHABET), c)

    def ratio(chars: Column) -> Column:
        steps = F.sequence(F.lit(1), F.size(chars) - 1)
        return F.aggregate(steps, F.lit(0.0), lambda acc, i: acc + F.get(table, place(F.get(chars, i - 1)) * SIZE + place(F.get(chars, i))))

    scored = F.transform(
        F.filter(matches(text, RUN), lambda m: ~F.exists(base, lambda b: (b["start"] < m["start"] + F.length(m["found"])) & (m["start"] < b["end"]))),
        lambda m: F.struct(m["start"].alias("start"), F.split(m["found"], "").alias("chars")),
    )
    rated = F.transform(scored, lambda m: F.struct(m["start"].alias("start"), F.size(m["chars"]).alias("n"), ratio(m["chars"]).alias("ratio")))
    hits = F.filter(rated, lambda m: (m["ratio"] >= min_ratio) & (m["ratio"] >= min_mean * m["n"]))
    return F.transform(hits, lambda m: F.struct(m["start"].alias("start"), F.lit(KINDS.index("markov")).alias("kind"), (m["start"] + m["n"]).alias("end")))


def with_spans(docs: DataFrame, ratios: list[float], text_col: str = "text") -> tuple[DataFrame, str, str]:
    """The documents with the pattern spans and all spans, by start and kind, and the names of the two columns."""
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    base = free_name(docs.columns, "base_spans")
    every = free_name([*docs.columns, base], "spans")
    found = docs.withColumn(base, base_spans(text).cast(_SPANS))
    return found.withColumn(every, F.array_sort(F.concat(F.col(base), markov_spans(text, ratios, F.col(base)))).cast(_SPANS)), base, every


def listed(spans: Column) -> Column:
    """``kind:start:end`` of spans, joined by commas."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")


def mask(docs: DataFrame, text_col: str = "text", mark: str = "[SECRET]", ratios: list[float] | None = None) -> DataFrame:
    """The documents with every span replaced by the mark, overlapping spans by one; null texts stay null."""
    found, base, every = with_spans(docs, train(docs, text_col) if ratios is None else ratios, text_col)
    text = F.col(f"`{text_col}`").cast("string")
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        gap = F.substr(text, acc["at"] + 1, s["start"] - acc["at"])
        return F.when(s["start"] < acc["at"], F.struct(F.greatest(acc["at"], s["end"]).alias("at"), acc["out"].alias("out"))).otherwise(
            F.struct(s["end"].alias("at"), F.concat(acc["out"], gap, F.lit(mark)).alias("out"))
        )

    masked = F.aggregate(F.col(every), start, step, lambda acc: F.concat(acc["out"], F.substr(text, acc["at"] + 1, F.length(text))))
    return found.withColumn(text_col, F.when(F.size(every) > 0, masked).otherwise(text)).drop(base, every)
