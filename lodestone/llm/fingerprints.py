"""Document fingerprints by one-permutation MinHash, in DataFrame operations only.

Each shingle of five words is hashed once.  The first bits of the hash name one of BINS
bins, and a bin keeps its least hash.  An empty bin is filled by optimal densification:
it looks at bins in an order that is drawn for it, the same for all documents, and takes
the value of the first one that isn't empty.  The order is ROUNDS draws of a 2-universal
hash, then all bins in order of another hash, so that it always ends, however few
shingles there are.  The last BITS bits of each value are packed.  Of two fingerprints a
share r of values agrees; unlike values agree in their last bits by chance with
probability 2^-BITS, so the likeness is (r - 2^-BITS) / (1 - 2^-BITS), 0 at least.

With BINS = 512 the likeness of long texts differs from the Jaccard coefficient of their shingles by
0.02 (standard error).
"""

from __future__ import annotations

from collections import Counter

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.licenses import _words

WORDS = 5
BINS, BITS = 512, 4
ROUNDS = 64
_SHIFT = 64 - (BINS - 1).bit_length()  # a hash's bin is what is left of it after this shift
_LOW = (1 << _SHIFT) - 1
_LANES = 64 // BITS  # values in a long
_ONES = sum(1 << BITS * n for n in range(_LANES))


def _column(df: DataFrame, name: str, value: Column, *drop: str) -> DataFrame:
    """``df`` with ``value`` computed once a row; as an expression a lambda would compute it for each element."""
    return df.select("*", F.explode(F.array(value)).alias(name)).drop(*drop)


def _shingles(text: str) -> Column:
    """Hashes of the runs of WORDS words; one of all words if there are fewer; of a text without words, of the text itself."""
    n = F.size("_w")
    runs = F.transform(F.slice("_w", 1, F.greatest(n - (WORDS - 1), F.lit(0))), lambda h, i: F.xxhash64(h, *[F.get("_w", i + j) for j in range(1, WORDS)]))
    few = F.array(F.aggregate("_w", F.lit(0).cast("long"), lambda a, h: F.xxhash64(a, h)))
    return F.when(n == 0, F.array(F.xxhash64(F.col(text)))).when(n < WORDS, few).otherwise(runs)


def with_fingerprint(df: DataFrame, text_col: str, name: str) -> DataFrame:
    """``df`` and ``name``, the packed values of the text's fingerprint, an array of BINS * BITS / 64 longs.  Texts must not be null."""
    df = _column(df, "_w", F.transform(_words(F.col(text_col)), lambda w: F.xxhash64(w)))
    # The largest hash of each bin goes with them and stands for "empty" where nothing comes before it.
    ends = F.lit([(n << _SHIFT) + _LOW for n in range(-BINS // 2, BINS // 2)]).cast("array<bigint>")
    df = _column(df, "_s", F.sort_array(F.concat(_shingles(text_col), ends)), "_w")
    first = F.filter("_s", lambda x, i: (i == 0) | (F.shiftright(x, _SHIFT) != F.shiftright(F.get("_s", i - 1), _SHIFT)))
    df = _column(df, "_b", F.transform(first, lambda x: F.when(x.bitwiseAND(F.lit(_LOW)) != _LOW, x)), "_s")
    # coalesce() stops at the first draw that finds a value.
    draw = lambda j, t: F.get("_b", F.xxhash64(j, F.lit(t)).bitwiseAND(F.lit(BINS - 1).cast("long")).cast("int"))
    df = _column(df, "_f", F.transform("_b", lambda x, j: F.coalesce(x, *[draw(j, t) for t in range(ROUNDS)])))
    open_ = F.exists("_f", lambda x: x.isNull())
    held = F.filter(F.transform("_b", lambda x, j: F.struct(j.alias("at"), x.alias("value"))), lambda b: b["value"].isNotNull())
    df = _column(df, "_h", F.when(open_, held), "_b")
    ranked = F.transform("_f", lambda x, j: F.coalesce(x, F.array_min(F.transform("_h", lambda b: F.struct(F.xxhash64(j, b["at"], F.lit(-1)), b["value"])))["value"]))
    df = _column(df, "_v", F.when(F.col("_h").isNull(), F.col("_f")).otherwise(ranked), "_f", "_h")
    low = lambda v: v.bitwiseAND(F.lit((1 << BITS) - 1).cast("long"))
    pack = lambda i: F.aggregate(F.slice("_v", i * _LANES + 1, _LANES), F.lit(0).cast("long"), lambda a, v: F.shiftleft(a, BITS).bitwiseOR(low(v)))
    return _column(df, name, F.transform(F.sequence(F.lit(0), F.lit(BINS // _LANES - 1)), pack), "_v")


def likeness(a: Column, b: Column) -> Column:
    """The similarity that two packed fingerprints show, 0 to 1."""

    def same(n: Column, x: Column) -> Column:
        any_bit = x
        for k in range(1, BITS):
            any_bit = any_bit.bitwiseOR(F.shiftrightunsigned(x, k))
        return n + _LANES - F.bit_count(any_bit.bitwiseAND(F.lit(_ONES)))

    share = F.aggregate(F.zip_with(a, b, lambda x, y: x.bitwiseXOR(y)), F.lit(0), same) / BINS
    chance = 2.0**-BITS
    return F.greatest((share - chance) / (1 - chance), F.lit(0.0))


def as_text(fp: Column) -> Column:
    """A packed fingerprint in hexadecimal digits."""
    return F.array_join(F.transform(fp, lambda v: F.lpad(F.hex(v), 16, "0")), "")


def _bucket(keys: DataFrame, parts: int) -> Column:
    """The number of a range of (_key, _tie).  The ranges hold about as many rows each; a key with more rows than a range is cut
    by _tie."""
    shares = [(n + 1) / parts for n in range(parts - 1)]
    bounds = sorted(keys.select(F.percentile_approx("_key", shares, max(10_000, 20 * parts))).first()[0] or []) if shares else []
    if not bounds:
        return F.lit(0)
    width = max(1, round(len(bounds) ** 0.5))
    below = lambda array: F.size(F.filter(array, lambda b: b < F.col("_key")))
    typed = lambda values: F.lit(values).cast("array<bigint>")
    coarse = F.greatest(below(typed(bounds[::width])) - 1, F.lit(0)) * width
    number = coarse + below(F.slice(typed(bounds), coarse + 1, F.lit(width)))
    hot = {key: n for key, n in Counter(bounds).items() if n > 1}
    if hot:
        many = F.element_at(F.create_map(*[F.lit(x).cast("bigint") for pair in hot.items() for x in pair]), F.col("_key"))
        number = number + F.coalesce(F.shiftright((F.shiftright("_tie", 33) + F.lit(1 << 30)) * many, 31), F.lit(0))
    return number.cast("int")


def with_next(rows: DataFrame, keys: DataFrame, carried: list[str], parts: int) -> DataFrame:
    """``rows`` and ``_next``, the struct ``carried`` of the row after it in descending order of (_key, _tie), which are ``keys``;
    after the last row comes the first.  Ranges are sorted each by itself; each also gets a copy of the row that comes after its last one."""
    bucket = _bucket(keys, parts)
    # One row for each range, at most ``parts``.
    heads = sorted((r["b"], *r["h"]) for r in keys.groupBy(bucket.alias("b")).agg(F.max(F.struct("_key", "_tie")).alias("h")).collect())
    guests = [(key, tie, heads[(n + 1) % len(heads)][0]) for n, (_, key, tie) in enumerate(heads)]
    sent = rows.sparkSession.createDataFrame(guests, "_key long, _tie long, _guest int")
    rows = rows.withColumn("_bucket", bucket).join(F.broadcast(sent), ["_key", "_tie"], "left")
    rows = rows.select("*", F.explode(F.when(F.col("_guest").isNull(), F.array(F.lit(False))).otherwise(F.array(F.lit(False), F.lit(True)))).alias("_is_guest"))
    rows = rows.withColumn("_bucket", F.when(F.col("_is_guest"), F.col("_guest")).otherwise(F.col("_bucket"))).drop("_guest")
    order = Window.partitionBy("_bucket").orderBy("_is_guest", F.col("_key").desc(), F.col("_tie").desc())
    return rows.withColumn("_next", F.lead(F.struct(*carried)).over(order)).where(~F.col("_is_guest")).drop("_is_guest", "_bucket")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", parts: int | None = None) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next``.

    A text's edited form has the last half of its characters (rounded down) replaced by the first as many of
    the next document's, or all that it has.  Documents go by descending id; rows that share an id by a hash of their text, and those without an
    id come last; after the last one comes the first, so a row alone is its own next.  Null texts are empty.  Equal texts have equal
    fingerprints, those without words too.  Columns other than id and text are not read.  An empty table gives no rows.
    """
    parts = parts or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    text = F.coalesce(F.col(text_col), F.lit(""))
    own = docs.select(F.col(id_col).cast("long").alias("_id"), text.alias("_text"))
    own = own.select("*", F.coalesce("_id", F.lit(-(1 << 63))).alias("_key"), F.xxhash64("_text").alias("_tie"))
    # A row's values are computed once, before it is dealt to its range.
    rows = with_next(with_fingerprint(own, "_text", "_fp"), own.select("_key", "_tie"), ["_text", "_fp"], parts)
    n = F.char_length("_text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.left("_text", n - half), F.left("_next._text", half))
    rows = rows.select("_id", n.cast("long").alias("n_chars"), "_fp", F.col("_next._fp").alias("_next_fp"), edited.alias("_edited"))
    rows = with_fingerprint(rows, "_edited", "_edited_fp")
    return rows.select(
        F.col("_id").alias("doc_id"), "n_chars", F.sha2("_edited", 256).alias("edited_sha256"), as_text(F.col("_fp")).alias("fingerprint"), as_text(F.col("_edited_fp")).alias("edited_fingerprint"),
        likeness(F.col("_fp"), F.col("_edited_fp")).alias("near_edited"), likeness(F.col("_fp"), F.col("_next_fp")).alias("near_next"),
    )
