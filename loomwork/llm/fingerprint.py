"""Exact document fingerprints from canonical text, with DataFrame and SQL functions only.

Canonical text: NFKC, full case folding, NFKC again, runs of white space as one space,
trimmed.  Normalisation comes from the Unicode library that Spark itself ships, called
through the SQL function ``reflect``.  A fingerprint is 128 bits wide: two xxhash64 lanes
over differently prefixed text.  Texts with equal lanes are compared byte by byte; should
two different texts ever share their lanes, their fingerprints also carry a SHA-256.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomwork.llm.shared import discard, free_name, integer_ids, let, stash

#: Distinct lanes up to which the table of repeated lanes is broadcast (24 MB); beyond, it is shuffled.
BROADCAST_ROWS = 1_000_000
#: Bytes of carried text that a range of keys should hold, and the most ranges (one long each in the plan's array).
RANGE_BYTES, RANGES = 2 << 20, 32_768


def _nfkc(text: Column) -> Column:
    return F.reflect(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), text, F.lit(True))


def _folded(text: Column) -> Column:
    return F.reflect(F.lit("com.ibm.icu.lang.UCharacter"), F.lit("foldCase"), text, F.lit(True))


def canonical(text: Column) -> Column:
    """Canonical form; null counts as empty.  Pure ASCII needs no Unicode tables."""
    text = F.coalesce(text, F.lit(""))
    plain = F.octet_length(text) == F.length(text)
    folded = F.when(plain, F.lower(text)).otherwise(_nfkc(_folded(_nfkc(text))))
    return F.trim(F.regexp_replace(folded, r"[\s\x{85}\x{1C}-\x{1F}\p{Z}]+", " "))


def lanes(canon: Column) -> list[Column]:
    return [F.xxhash64(F.lit("lane one"), canon), F.xxhash64(F.lit("lane two"), canon)]


def _hex(a: Column, b: Column) -> Column:
    return F.lower(F.concat(F.lpad(F.hex(a), 16, "0"), F.lpad(F.hex(b), 16, "0")))


def collided(pool: DataFrame, keys: DataFrame) -> DataFrame:
    """Lanes (l1, l2) under which texts of pool(l1, l2, canon) differ; keys: (l1, l2) of each row of pool.

    Only rows whose lanes repeat are compared; least and greatest text of a bucket are
    found within each task first, so a bucket with a third of all rows moves one pair a task.
    """
    multi = stash(keys.groupBy("l1", "l2").count().filter("count > 1").select("l1", "l2"), "lanes")
    side = F.broadcast(multi) if multi.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else multi
    suspects = pool.join(side, ["l1", "l2"], "left_semi")
    return suspects.groupBy("l1", "l2").agg(F.min("canon").alias("a"), F.max("canon").alias("z")).filter("a <> z").select("l1", "l2")


def fingerprint_of(l1: Column, l2: Column, sha: Column, clash: Column) -> Column:
    return F.when(clash, F.concat(_hex(l1, l2), F.lit("-"), sha)).otherwise(_hex(l1, l2))


def fingerprints(df: DataFrame, text_col: str = "text", out_col: str = "fingerprint") -> DataFrame:
    """df with the fingerprint of each whole text (a column ``out_col`` of df is replaced).

    Null and empty texts share the fingerprint of the empty text; repeated rows stay.
    """
    base = df.drop(out_col)
    canon = base.select(canonical(F.col(text_col)).alias("canon")).select("canon", *[c.alias(n) for c, n in zip(lanes(F.col("canon")), ("l1", "l2"))])
    clash = stash(collided(canon, canon.select("l1", "l2")), "clash")
    hard = [(r.l1, r.l2) for r in clash.limit(10_000).collect()]
    discard(clash)
    text, l1, l2 = (free_name(n, *base.columns, out_col) for n in ("__canon", "__l1", "__l2"))
    whole = base.withColumn(text, canonical(F.col(text_col))).withColumns(dict(zip((l1, l2), lanes(F.col(text)))))
    mark = clash_test(F.col(l1), F.col(l2), hard)
    return whole.withColumn(out_col, fingerprint_of(F.col(l1), F.col(l2), F.sha2(text, 256), mark)).drop(text, l1, l2)


def clash_test(l1: Column, l2: Column, hard: list[tuple[int, int]]) -> Column:
    """Whether lanes are among those of different texts.

    Their number follows from chance alone (about n * n / 2 ** 129), so the list is empty in practice.
    """
    if len(hard) >= 10_000:
        raise RuntimeError("the lanes of different texts agree too often; the hash is broken")
    return F.struct(l1, l2).isin([F.struct(F.lit(a), F.lit(b)) for a, b in hard]) if hard else F.lit(False)


def _locate(key: Column, bounds: list) -> Column:
    """Number of bounds up to key, by bisection over one array; null keys come before all bounds."""
    if not bounds:
        return F.lit(0)
    whole = all(isinstance(b, int) for b in bounds)
    held = F.from_json(F.lit(str(bounds)), "array<bigint>") if whole else F.array(*[F.lit(b) for b in bounds])
    steps = F.sequence(F.lit(1), F.lit(len(bounds).bit_length()))

    def search(sorted_: Column) -> Column:
        def halve(at: Column, _: Column) -> Column:
            mid = F.shiftright(at["lo"] + at["hi"], 1)
            up = F.get(sorted_, mid) <= key
            # lo counts bounds known to be up to key, hi those that may be
            return F.when(at["lo"] >= at["hi"], at).otherwise(F.struct(F.when(up, mid + 1).otherwise(at["lo"]).alias("lo"), F.when(up, at["hi"]).otherwise(mid).alias("hi")))

        return F.aggregate(steps, F.struct(F.lit(0).alias("lo"), F.lit(len(bounds)).alias("hi")), halve, lambda at: at["lo"])

    return F.when(key.isNull(), F.lit(0)).otherwise(let(held, search))


def with_next(df: DataFrame, key: str, carried: list[str], weight: Column | None = None) -> DataFrame:
    """df with ``next_<c>`` for each carried column: the row next in descending key, after the last the first.

    Rows are dealt to ranges of the key by its quantiles; the greatest row of a range is
    also sent to the range above it, where it follows the last.  So each range is a
    window of its own and the rows are shuffled once.  The number of ranges follows the
    sum of ``weight`` (bytes; by default of the carried columns' text), not the cluster,
    and the plan's size does not depend on it.  Null keys count as smallest; ties go by
    the carried columns, and the rows of one key stay in one range (a window streams over
    them and spills).  Columns named ``next_<c>`` are replaced.
    """
    base = df.drop(*[f"next_{c}" for c in carried])
    part, ghost, seat = (free_name(n, *base.columns, *[f"next_{c}" for c in carried]) for n in ("__part", "__ghost", "__seat"))
    size = weight if weight is not None else sum((F.coalesce(F.octet_length(F.col(c).cast("string")), F.lit(0)) for c in carried), F.lit(0))
    total = base.agg(F.sum(size.cast("long"))).first()[0] or 0
    n = min(RANGES, -(-total // RANGE_BYTES))
    found = base.agg(F.percentile_approx(key, [i / n for i in range(1, n)], max(10_000, 10 * n))).first()[0] if n > 1 else []
    dealt = base.withColumn(part, _locate(F.col(key), sorted(set(found or []))))
    # one row for each range, so at most RANGES
    heads = dealt.groupBy(part).agg(F.max(key).alias("head")).orderBy(part).collect()
    if not heads:
        heads = [(0, None)]
    above = [heads[(k + 1) % len(heads)][0] for k in range(len(heads))]
    kind = base.schema[key].dataType
    table = df.sparkSession.createDataFrame([(h[0], h[1], up) for h, up in zip(heads, above)], f"p_ int, head_ {kind.simpleString()}, up_ int")
    marked = dealt.join(F.broadcast(table), F.col(part) == F.col("p_"), "left")
    own = F.struct(F.col(part).alias("p"), F.lit(False).alias("g"))
    seats = F.when(F.col(key).eqNullSafe(F.col("head_")), F.array(own, F.struct(F.col("up_").alias("p"), F.lit(True).alias("g")))).otherwise(F.array(own))
    seated = marked.select(*[F.col(f"`{c}`") for c in base.columns], F.explode(seats).alias(seat))
    seated = seated.withColumn(part, F.col(f"{seat}.p")).withColumn(ghost, F.col(f"{seat}.g")).drop(seat)
    w = Window.partitionBy(part).orderBy(F.col(ghost), F.col(key).desc_nulls_last(), *[F.col(c) for c in carried])
    led = seated.select("*", *[F.lead(c).over(w).alias(f"next_{c}") for c in carried])
    return led.filter(~F.col(ghost)).drop(ghost, part)


def edited_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of each text and of its edited text, and their likeness (1.0 if equal, else 0.0).

    The edited text has its last half replaced by as many code points from the start of
    the next document in descending id.  An exact digest has no degrees: any edit that
    survives canonical form makes the likeness 0.  Ids are integers.
    """
    integer_ids(docs, id_col)
    base = docs.select(F.col(id_col), F.coalesce(text_col, F.lit("")).alias("text"))
    keyed = base.withColumn("canon", canonical(F.col("text"))).select(id_col, "text", *[c.alias(n) for c, n in zip(lanes(F.col("canon")), ("t1", "t2"))], F.sha2("canon", 256).alias("ts"))
    n, half = F.length("text"), F.floor(F.length("text") / 2).cast("int")
    paired = with_next(keyed, id_col, ["text", "t1", "t2", "ts"], F.octet_length("text")).select(
        id_col, n.cast("long").alias("n_chars"), F.concat(F.substring(F.col("text"), F.lit(1), n - half), F.substring(F.col("next_text"), F.lit(1), half)).alias("edited"),
        "t1", "t2", "ts", "next_t1", "next_t2", "next_ts",
    )
    done = stash(
        paired.withColumn("canon", canonical(F.col("edited"))).withColumn("e1", lanes(F.col("canon"))[0]).withColumn("e2", lanes(F.col("canon"))[1])
        .withColumn("es", F.sha2("canon", 256)).withColumn("edited_sha256", F.sha2("edited", 256)).drop("canon"), "edited",
    )
    both = lambda frame, text: frame.select(canonical(F.col(text)).alias("canon")).select("canon", *[c.alias(n) for c, n in zip(lanes(F.col("canon")), ("l1", "l2"))])
    pool = both(base, "text").unionByName(both(done, "edited"))
    keys = done.select(F.col("t1").alias("l1"), F.col("t2").alias("l2")).unionAll(done.select("e1", "e2"))
    hard = [(r.l1, r.l2) for r in collided(pool, keys).limit(10_000).collect()]
    of = lambda a, b, s: fingerprint_of(F.col(a), F.col(b), F.col(s), clash_test(F.col(a), F.col(b), hard))
    out = done.select(id_col, "n_chars", "edited_sha256", of("t1", "t2", "ts").alias("fingerprint"), of("e1", "e2", "es").alias("edited_fingerprint"), of("next_t1", "next_t2", "next_ts").alias("next"))
    alike = lambda a, b: (F.col(a) == F.col(b)).cast("double")
    return out.select(id_col, "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", alike("fingerprint", "edited_fingerprint").alias("near_edited"), alike("fingerprint", "next").alias("near_next"))
