"""Document fingerprints with column expressions only: a homomorphic multiset hash of paragraphs.

A paragraph (line) has a wide vector: EXACT lanes of a keyed hash of the whole
paragraph, and SKETCH lanes in which each of its clauses adds +1 or -1 at a hashed
place, so that likeness says little of texts with one or two clauses. A fingerprint is the sum over paragraphs, exact lanes modulo 2**32,
sketch lanes modulo 2**16. So the order of paragraphs is without effect, and
fingerprints add and subtract as paragraphs come and go (`combined`). Equality
of texts is that of all lanes; likeness is the cosine of the sketch lanes.

Defined results: null text is empty, and an empty text is one empty paragraph;
repeated rows stay; of several texts with one id the smallest counts as that id's
text for its predecessor; a row with a null id has no next document, which then
counts as empty with likeness 0; with one id the next document is itself; an
empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import stage
from .common import next_ids

EXACT = 8
SKETCH = 64
_WORD, _HALF = 1 << 32, 1 << 31


CLAUSE = r"[.,;:!?|]+"


def _lanes(rows: DataFrame, keys: list[str]) -> DataFrame:
    """keys, exact (array of EXACT longs), sketch (array of SKETCH ints), summed over the paragraphs `p` of each key.

    Keys stay whole in their partition, so grouping by them needs no exchange.
    Two sketch lanes are summed in one long, as halves.
    """
    half = EXACT // 2
    hashes = [F.xxhash64(F.lit(k), "p").alias(f"h{k}") for k in range(half)]
    each = rows.select(*keys, *hashes, F.posexplode(F.split("p", CLAUSE)).alias("at", "clause"))
    each = each.select(*keys, *[f"h{k}" for k in range(half)], "at", F.xxhash64("clause").alias("c"))
    one = F.lit(1).cast("long")
    sign = F.when(F.col("c").bitwiseAND(F.lit(SKETCH)) == 0, one).otherwise(-one)
    each = each.withColumns({"q": F.shiftright("c", 1).bitwiseAND(F.lit(SKETCH // 2 - 1)).cast("int"), "v": F.when(F.col("c").bitwiseAND(F.lit(1)) == 0, sign).otherwise(sign * _WORD)})
    first, zero, sums = F.col("at") == 0, F.lit(0).cast("long"), []
    for k in range(half):
        low, high = F.col(f"h{k}").bitwiseAND(F.lit(_WORD - 1)), F.shiftrightunsigned(f"h{k}", 32)
        sums += [F.sum(F.when(first, low).otherwise(zero)).alias(f"e{2 * k}"), F.sum(F.when(first, high).otherwise(zero)).alias(f"e{2 * k + 1}")]
    sums += [F.sum(F.when(F.col("q") == j, F.col("v")).otherwise(zero)).alias(f"s{j}") for j in range(SKETCH // 2)]
    got = each.groupBy(*keys).agg(*sums)
    low = lambda s: F.pmod(s + _HALF, F.lit(_WORD)) - _HALF
    halves = F.flatten(F.transform(F.array(*[f"s{j}" for j in range(SKETCH // 2)]), lambda s: F.array(low(s), F.shiftright(s - low(s), 32))))
    return got.select(*keys, F.array(*[f"e{k}" for k in range(EXACT)]).alias("exact"), halves.cast("array<int>").alias("sketch"))


def _hex(c: Column, digits: int) -> Column:
    return F.lpad(F.hex(F.pmod(c.cast("long"), F.lit(1 << (4 * digits)))), digits, "0")


def _hexer(digits: int):
    return lambda x: _hex(x, digits)


def packed(exact: str | Column, sketch: str | Column) -> Column:
    """The fingerprint string: exact lanes at eight hex digits, sketch lanes at four."""
    parts = [F.array_join(F.transform(a, _hexer(n)), "") for a, n in ((exact, 8), (sketch, 4))]
    return F.lower(F.concat(*parts))


def lanes_of(fp: Column) -> tuple[Column, Column]:
    """A fingerprint's exact lanes, and its sketch lanes as signed numbers."""
    part = lambda at, n: F.conv(F.substring(fp, at, n), 16, 10).cast("long")
    exact = F.array(*[part(1 + 8 * k, 8) for k in range(EXACT)])
    signed = [part(1 + 8 * EXACT + 4 * k, 4) for k in range(SKETCH)]
    return exact, F.array(*[F.when(x >= 1 << 15, x - (1 << 16)).otherwise(x) for x in signed])


def combined(a: Column, b: Column, sign: int = 1) -> Column:
    """Fingerprint of the paragraphs of both (sign 1), or of a's without b's (sign -1)."""
    (ea, sa), (eb, sb) = lanes_of(a), lanes_of(b)
    added = lambda x, y: F.zip_with(x, y, lambda p, q: p + sign * q)
    return packed(added(ea, eb), added(sa, sb))


def _likeness(xy: Column, xx: Column, yy: Column, same: Column) -> Column:
    c = F.greatest(F.lit(0.0), F.least(F.lit(1.0), xy / F.sqrt(xx * yy)))
    return F.when(same, 1.0).when((xx == 0) | (yy == 0), 0.0).when(xy.isNotNull(), c)


def _cosine(x: Column, y: Column, same: Column) -> Column:
    dot = lambda u, v: F.aggregate(F.zip_with(u, v, lambda p, q: p.cast("double") * q), F.lit(0.0), lambda s, z: s + z)
    return _likeness(dot(x, y), dot(x, x), dot(y, y), same)


def likeness(a: Column, b: Column) -> Column:
    """Cosine of two fingerprints' sketch lanes, not below 0; 1 for equal fingerprints."""
    return _cosine(lanes_of(a)[1], lanes_of(b)[1], a == b)


def fingerprints(rows: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """keys, exact, sketch, fp: one fingerprint per key, whose rows hold its text or parts of it."""
    parts = rows.select(*keys, F.explode(F.split(F.coalesce(F.col(text), F.lit("")), "\n")).alias("p"))
    return _lanes(parts, keys).withColumn("fp", packed("exact", "sketch"))


def edited(docs: DataFrame) -> DataFrame:
    """gone, id, h, copies, text, edited, next_id, next_h: each distinct row with its edited text.

    Text is dealt by id once; what comes back to a row is only the beginning of
    the next document, as long as it needs. A row without doc_id is `gone` and
    goes by a hash of its text, so that no step treats nulls apart and all read
    one exchange.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    real = F.col("doc_id").cast("long")
    dealt = docs.select(real.isNull().alias("gone"), F.coalesce(real, F.xxhash64(text)).alias("id"), text.alias("text")).repartition("id")
    rows = dealt.groupBy("gone", "id", "text").agg(F.count(F.lit(1)).alias("copies")).withColumn("h", F.xxhash64("text"))
    first = dealt.groupBy("id").agg(F.min(F.when(~F.col("gone"), F.col("text"))).alias("next_text")).withColumnRenamed("id", "k")
    want = rows.select("id", "h", F.floor(F.length("text") / 4).cast("int").alias("m")).join(next_ids(docs.select(real.alias("id")), "id"), "id")
    sent = want.join(first, F.col("next_id") == F.col("k")).select("id", F.struct("h", "next_id", F.xxhash64("next_text").alias("next_h"), F.col("next_text").substr(F.lit(1), F.col("m")).alias("start")).alias("s"))
    sent = sent.groupBy("id").agg(F.collect_list("s").alias("sent"))
    met = rows.join(sent, "id", "left").withColumn("s", F.when(~F.col("gone"), F.filter("sent", lambda s: s["h"] == F.col("h"))[0]))
    n = F.length("text")
    whole = F.concat(F.col("text").substr(F.lit(1), (n - F.floor(n / 4)).cast("int")), F.coalesce("s.start", F.lit("")))
    return met.select("gone", "id", "h", "copies", "text", whole.alias("edited"), "s.next_id", "s.next_h")


def compared(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next."""
    rows = edited(docs)
    kept = ["gone", "id", "h", "copies", "next_id", "next_h", "n_chars", "edited_sha256"]
    both = rows.select(
        "gone", "id", "h", "copies", "next_id", "next_h", F.length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"),
        F.posexplode(F.array("text", "edited")).alias("kind", "t"),
    )
    prints = fingerprints(both.select(*kept, "kind", F.col("t").alias("text")), [*kept, "kind"])
    of = lambda k: F.max(F.when(F.col("kind") == k, F.struct("fp", "sketch")))
    pair = prints.groupBy(*kept).agg(of(0).alias("a"), of(1).alias("b"))
    near = _cosine(F.col("a.sketch"), F.col("b.sketch"), F.col("a.fp") == F.col("b.fp"))
    pair = stage(pair.select(*kept, F.col("a.fp").alias("fp"), F.col("a.sketch").alias("sketch"), F.col("b.fp").alias("efp"), near.alias("near_edited")))
    other = pair.filter(~F.col("gone")).select(F.col("id").alias("k"), F.col("h").alias("kh"), F.col("fp").alias("next_fp"), F.col("sketch").alias("next_sketch"))
    out = pair.join(other, (F.col("next_id") == F.col("k")) & (F.col("next_h") == F.col("kh")), "left")
    near = F.coalesce(_cosine(F.col("sketch"), F.col("next_sketch"), F.col("fp") == F.col("next_fp")), F.lit(0.0))
    out = out.select(F.when(~F.col("gone"), F.col("id")).alias("doc_id"), "n_chars", "edited_sha256", F.col("fp").alias("fingerprint"), F.col("efp").alias("edited_fingerprint"), "near_edited", near.alias("near_next"), F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int"))).alias("c"))
    return out.drop("c")
