"""One-permutation MinHash fingerprints in DataFrame expressions.

Each five-word shingle of a text is hashed once: the hash's low bits choose one of ``BINS`` bins and the rest is its
value there; a bin keeps the least. An empty bin takes the value of the first full bin on a probe sequence of its own
(optimal densification; the sequence depends on the bin alone, so equal sets stay equal). The fingerprint stores the
low ``BITS`` bits of each bin as one hex digit; the likeness of two fingerprints is the share of equal digits, corrected for
the 1 in 16 that agree by chance.

Everything stays in the JVM: shingles are exploded and grouped inside the partitions the texts already lie in.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.llm.common import hot_keys, partitions, text_or_empty

BINS = 256
BITS = 4
WORDS = 5
PROBES = 12


def word_hashes(text: Column) -> Column:
    """Hash of each word of a text, lower-cased; words are runs without white space."""
    return F.transform(F.filter(F.split(F.lower(text), r"\s+"), lambda w: w != ""), lambda w: F.xxhash64(w))


def _probe(b: Column, j: Column | int) -> Column:
    """The j-th bin that bin b asks: an arithmetic sequence whose start and odd step are hashes of b, so that all bins come up."""
    start, step = F.shiftright(b * 40503 + 12345, 5), F.shiftright(b * 48271 + 54321, 6).bitwiseOR(1)
    return (start.bitwiseAND(BINS - 1) + step.bitwiseAND(BINS - 1) * j).bitwiseAND(BINS - 1)


def filled(masks: list[Column], packed: Column) -> Column:
    """The ``BINS`` values with nulls for empty bins: ``packed`` holds the full bins' values in order, ``masks`` 64 bins' bits each."""

    def value(b: Column) -> Column:
        word = F.shiftright(b, 6)
        mask, before = masks[0], F.lit(0)
        for k in range(1, len(masks)):
            mask = F.when(word == k, masks[k]).otherwise(mask)
            before = before + F.when(word >= k, F.bit_count(masks[k - 1])).otherwise(0)
        upto = F.call_function("shiftleft", mask, F.lit(63) - b.bitwiseAND(63))  # the bits of this bin and those before it, at the top
        return F.when(upto < 0, F.get(packed, before + F.bit_count(upto) - 1))

    return F.transform(F.sequence(F.lit(0), F.lit(BINS - 1)), value)


def densified(values: Column) -> Column:
    """The ``BINS`` values of an array with nulls for empty bins, densified; all null if all are empty."""

    def value(b: Column) -> Column:
        asked = [F.get(values, _probe(b, j)) for j in range(PROBES)]
        # Few shingles: go on along the sequence to its end.
        rest = F.get(F.filter(F.transform(F.sequence(F.lit(PROBES), F.lit(BINS - 1)), lambda j: F.get(values, _probe(b, j))), lambda v: v.isNotNull()), F.lit(0))
        return F.coalesce(F.get(values, b), *asked, rest)

    return F.transform(F.sequence(F.lit(0), F.lit(BINS - 1)), value)


def digits(values: Column) -> Column:
    """The low bits of each bin; an empty array for a text without words.

    They are taken from a hash of value and bin, else all bins that borrow from one would agree by chance together.
    """
    return F.when(F.get(values, F.lit(0)).isNull(), F.array().cast("array<int>")).otherwise(F.transform(values, lambda v, b: F.xxhash64(v, b).bitwiseAND((1 << BITS) - 1).cast("int")))


def fingerprint(digits_: Column) -> Column:
    """Digits as a hex string."""
    return F.concat_ws("", F.transform(digits_, lambda d: F.substring(F.lit("0123456789abcdef"), d + 1, F.lit(1))))


def likeness(a: Column, b: Column) -> Column:
    """Estimated Jaccard similarity of two arrays of digits, between 0 and 1; two texts without words are alike."""
    chance = 1.0 / (1 << BITS)
    equal = F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda e: e))
    share = (equal.cast("double") / BINS - chance) / (1 - chance)
    none = (F.size(a) == 0) | (F.size(b) == 0)
    return F.when(none, (F.size(a) == F.size(b)).cast("double")).otherwise(F.greatest(F.least(share, F.lit(1.0)), F.lit(0.0)))


def fingerprints(df: DataFrame, keys: list[str], text_column: str = "text") -> DataFrame:
    """keys, digits of each row of texts whose ``keys`` are unique; no shuffle if the rows are partitioned by some of the keys.

    A null or wordless text has no digits.
    """
    rows = df.select(*keys, word_hashes(text_or_empty(text_column)).alias("words"))
    n = F.size("words")
    # A row for each shingle; a wordless text keeps one row with a null bin.
    at = F.explode_outer(F.when(n > 0, F.sequence(F.lit(0), F.greatest(n - WORDS, F.lit(0)))))
    exploded = rows.select(*keys, "words", at.alias("at"))
    h = F.when(F.col("at").isNotNull(), F.xxhash64(*[F.get(F.col("words"), F.col("at") + k) for k in range(WORDS)]))
    hashed = exploded.select(*keys, h.alias("h"))
    # The bin stands in the upper bits, so values in numeric order are in order of their bins.
    hashed = hashed.select(*keys, F.col("h").bitwiseAND(BINS - 1).cast("int").alias("bin"), F.shiftrightunsigned("h", BINS.bit_length()).alias("value"))
    bins = hashed.groupBy(*keys, "bin").agg(F.min("value").alias("value"))
    masks = [F.coalesce(F.bit_or(F.when(F.shiftright("bin", 6) == k, F.call_function("shiftleft", F.lit(1).cast("long"), F.col("bin").bitwiseAND(63)))), F.lit(0).cast("long")).alias(f"m{k}") for k in range(BINS // 64)]
    in_place = F.shiftleft(F.col("bin").cast("long"), 63 - BINS.bit_length() + 1).bitwiseOR(F.col("value"))
    by = bins.groupBy(*keys).agg(F.sort_array(F.collect_list(in_place)).alias("packed"), *masks)
    by = by.select(*keys, filled([F.col(f"m{k}") for k in range(BINS // 64)], F.col("packed")).alias("filled"))
    return by.select(*keys, densified(F.col("filled")).alias("dense")).select(*keys, digits(F.col("dense")).alias("digits"))


def in_order(df: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """bucket, doc, tie, text, extra: rows dealt to buckets by range of (id, hash of the text), so that a bucket holds its rows' successors.

    A bucket's range starts with a row that is there; rows like it go to the bucket before as well (``extra`` 1), and rows
    like the least one to the last bucket (``extra`` 2). The ranges are a quantile sketch of the ids, four for each shuffle
    partition, so that partitions get about equal shares when buckets are dealt by hash; an id with more rows than that (null
    ids, say) is cut by its texts' hashes. At most 20 bounds for each shuffle partition come to the driver.
    """
    spark = df.sparkSession
    n = 4 * partitions(spark)
    rows = df.select(F.col(id_column).cast("long").alias("doc"), text_or_empty(text_column).alias("text"))
    ids = rows.select("doc")
    cuts, nulls, least = ids.agg(F.percentile_approx("doc", F.array(*[F.lit(k / n) for k in range(1, n)]) if n > 1 else F.array(F.lit(0.5)), 10_000), F.count_if(F.col("doc").isNull()), F.min("doc")).first()
    hot = hot_keys(ids.groupBy(F.col("doc").alias("key")).agg(F.count("*").alias("n"))).collect()
    first_id = None if nulls else least
    pieces = {c: 1 for c in (*(cuts or []), first_id)} | {r.key: r.pieces for r in hot}
    listed = F.array(*[F.struct(F.lit(k).cast("long").alias("cut"), F.lit(p).cast("int").alias("pieces")) for k, p in pieces.items()])
    cut_ids = F.broadcast(spark.range(1).select(F.inline(listed)))
    tied = rows.select("doc", F.xxhash64("text").alias("tie")).join(cut_ids, F.col("doc").eqNullSafe(F.col("cut")))
    piece = F.floor((F.col("tie") / float(1 << 64) + 0.5) * F.col("pieces"))
    found = sorted((r.doc is not None, r.doc or 0, r.tie) for r in tied.groupBy("doc", piece.alias("piece")).agg(F.min("tie").alias("tie")).collect())

    def place(known: Column, doc: Column, tie: Column) -> Column:
        return F.struct(known.cast("int").alias("k"), doc.cast("long").alias("d"), tie.cast("long").alias("t"))

    own_place = place(F.col("doc").isNotNull(), F.coalesce("doc", F.lit(0)), F.xxhash64("text"))
    bounds = F.array(*[place(*map(F.lit, x)) for x in found[1:]]) if len(found) > 1 else F.array().cast("array<struct<k:int,d:bigint,t:bigint>>")
    placed = rows.withColumn("place", own_place)
    bucket = F.size(F.filter(bounds, lambda c: c <= F.col("place")))
    own = F.struct(bucket.alias("bucket"), F.lit(0).alias("extra"))
    before = F.when(F.exists(bounds, lambda c: c == F.col("place")), F.struct((bucket - 1).alias("bucket"), F.lit(1).alias("extra")))
    is_least = F.col("place") == place(*map(F.lit, found[0])) if found else F.lit(False)
    wrap = F.when(is_least, F.struct(F.lit(max(0, len(found) - 1)).alias("bucket"), F.lit(2).alias("extra")))
    return placed.select("doc", "text", F.col("place.t").alias("tie"), F.inline(F.filter(F.array(own, before, wrap), lambda x: x.isNotNull())))


def edited_fingerprints(df: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Fingerprints of each whole text and of its edited text, whose last quarter gives way to the start of the next document.

    Returns id_column, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next. The next row is the
    next one by (id, hash of the text), nulls first, and the first after the last; the only row is its own next. A null
    text is empty. Repeated rows follow each other. Other columns are not read.
    """
    order = Window.partitionBy("bucket").orderBy("extra2", F.col("doc").asc_nulls_first(), "tie", "extra")
    # Rows of the wrap-around stand behind all others of their bucket.
    dealt = in_order(df, id_column, text_column).withColumn("extra2", (F.col("extra") == 2).cast("int"))
    dealt = dealt.repartition(partitions(df.sparkSession), "bucket")
    following = dealt.select("bucket", "doc", "text", "extra", F.row_number().over(order).alias("place"), F.lead("text").over(order).alias("next"))
    n = F.length("text")
    cut = F.floor(n / 4).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - cut), F.substring(F.coalesce("next", F.lit("")), F.lit(1), cut))
    both = following.select("bucket", "place", "doc", "extra", "text", F.when(F.col("extra") == 0, edited).alias("edited"))
    versions = F.inline(F.filter(F.array(F.struct(F.lit(0).alias("version"), F.col("text").alias("body")), F.struct(F.lit(1).alias("version"), F.col("edited").alias("body"))), lambda v: v["body"].isNotNull()))
    each = both.select("bucket", "place", "doc", "extra", versions)
    keys = ["bucket", "place", "doc", "extra", "version"]
    with_facts = each.select(*keys, "body", F.length("body").cast("long").alias("n_chars"), F.when(F.col("version") == 1, F.sha2("body", 256)).alias("sha"))
    prints = fingerprints(with_facts, [*keys, "n_chars", "sha"], "body")
    rows = prints.groupBy("bucket", "place", "doc", "extra").agg(
        F.max(F.when(F.col("version") == 0, F.col("n_chars"))).alias("n_chars"),
        F.max("sha").alias("edited_sha256"),
        F.max(F.when(F.col("version") == 0, F.col("digits"))).alias("digits"),
        F.max(F.when(F.col("version") == 1, F.col("digits"))).alias("edited_digits"),
    )
    after = rows.withColumn("next_digits", F.lead("digits").over(Window.partitionBy("bucket").orderBy("place"))).where("extra = 0")
    return after.select(
        F.col("doc").alias(id_column),
        "n_chars",
        "edited_sha256",
        fingerprint(F.col("digits")).alias("fingerprint"),
        fingerprint(F.col("edited_digits")).alias("edited_fingerprint"),
        likeness(F.col("digits"), F.col("edited_digits")).alias("near_edited"),
        likeness(F.col("digits"), F.col("next_digits")).alias("near_next"),
    )
