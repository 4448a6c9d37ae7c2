"""HEIC files without their metadata items, by joins over the rows of their tables.

Item entries meet item places by id; gates are anti-joins, containment and overlap of
extents; what is cut are rows (start, stop), and new offsets and box sizes follow from
running totals of cuts.  Only a file's list of edits meets its content again.
"""

from __future__ import annotations

import copy

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomwork.operators import intervals, items, parts
from loomwork.operators.parts import _be
from loomwork.shared import stash

GATES = ("tracks", "groups", "layout", "no_place", "primary", "nothing_left", "outside", "shared", "early")


def wide(df: DataFrame) -> DataFrame:
    """df, never broadcast: a written table is a few compressed bytes a row, so by its size Spark would collect millions of rows in the driver."""
    return df.hint("merge")


class Tables:
    """The written rows of boxes, items, extents, references and associations of some files, by ``f``.

    Files are read once; what many steps ask for is written too, not joined again by each.
    """

    def __init__(self, files: DataFrame):
        rows = stash(parts.heif_rows(files, "f"), "rows", by="tbl")
        read = lambda name, *more: rows.filter(F.col("tbl") == name).select("f", f"{name}.*", *more)
        self.boxes, self.items, self.extents = read("boxes"), read("items"), read("extents", "fits", "sha")
        self.references, self.associations = read("references"), read("associations")
        #: metadata items, and places with a flag whether they go (items of entries meet places by id)
        self.gone = stash(self.items.filter("label is not null").groupBy("f", "item").agg(F.max_by("label", "ord").alias("label"), F.bool_or("is_primary").alias("is_primary")), "gone")
        flags = self.gone.select("f", "item", F.lit(True).alias("goes"))
        self.places = stash(self.extents.filter("error is null").join(wide(flags), ["f", "item"], "left").withColumn("goes", F.coalesce("goes", F.lit(False))), "places")

    def only(self, files: DataFrame) -> Tables:
        """The tables of some of the files, written."""
        some = copy.copy(self)
        for name in ("boxes", "items", "references", "associations", "gone", "places"):
            setattr(some, name, stash(getattr(self, name).join(wide(files), "f", "left_semi"), name))
        return some

    def mdats(self) -> DataFrame:
        return self.boxes.filter("depth = 0 and kind = 'mdat'")

    def payloads(self) -> DataFrame:
        """(f, start, len) of each extent that goes."""
        return self.places.filter("goes and extent is not null").select("f", F.col("begin").alias("start"), F.col("size").alias("len"))


def gates(t: Tables) -> DataFrame:
    """(f, corrupt, plain, and each of GATES as a flag): whether a file can be read, has nothing to lose, and why it can't be rewritten."""
    flag = lambda df, name: df.select("f", F.lit(name).alias("gate")).distinct()
    broken = flag(t.boxes.filter("error is not null").unionByName(t.items.filter("error is not null"), allowMissingColumns=True), "corrupt")
    found = [broken, flag(t.gone, "has")]
    found.append(flag(t.boxes.filter("depth = 0 and kind = 'moov'"), "tracks"))
    found.append(flag(t.boxes.filter("depth = 1 and kind = 'grpl'"), "groups"))
    for table in (t.extents, t.references, t.associations):
        found.append(flag(table.filter("error is not null"), "layout"))
    found.append(flag(items.without_place(t.gone, wide(t.places), ["f", "item"]), "no_place"))
    found.append(flag(t.gone.filter("is_primary"), "primary"))
    kept = t.places.filter("not goes")
    found.append(flag(t.gone.select("f").distinct().join(wide(kept), "f", "left_anti"), "nothing_left"))
    mdats = t.mdats().select("f", F.col("data").alias("start"), (F.col("stop") - F.col("data")).alias("len"))
    payloads = t.payloads().withColumn("n", F.monotonically_increasing_id())
    payloads = stash(payloads, "payloads")
    inside = intervals.contained(payloads, mdats, "f")
    found.append(flag(payloads.join(wide(inside.select("n")), "n", "left_anti"), "outside"))
    # places doubled, so that an empty extent inside what goes is met as well
    removed = intervals.merged(payloads.drop("n"), "f").select("f", (2 * F.col("start") + 1).alias("start"), (2 * F.col("len") - 1).alias("len"))
    staying = kept.filter("extent is not null").select("f", (2 * F.col("begin")).alias("start"), F.greatest(2 * F.col("size"), F.lit(1)).alias("len"))
    found.append(flag(intervals.overlapping(staying, removed, "f"), "shared"))
    metas = t.boxes.filter("depth = 0 and kind = 'meta'").groupBy("f").agg(F.min_by("stop", "ord").alias("meta_stop"))
    early = (F.col("begin") < F.col("meta_stop")) | ((F.col("base_width") > 0) & (F.col("base") < F.col("meta_stop")))
    found.append(flag(kept.join(wide(metas), "f").filter(early), "early"))
    every = found[0]
    for one in found[1:]:
        every = every.unionByName(one)
    has = lambda name: F.coalesce(F.bool_or(F.col("gate") == name), F.lit(False))
    files = t.boxes.select("f").distinct().join(wide(every), "f", "left")
    return files.groupBy("f").agg(has("corrupt").alias("corrupt"), (~has("has")).alias("plain"), *[has(g).alias(g) for g in GATES])


def outcome() -> Column:
    """Of gates()."""
    shut = F.greatest(*[F.col(g) for g in GATES])
    return F.when(F.col("corrupt"), "corrupt").when(~F.col("plain") & shut, "unsupported_layout").otherwise("ok")


def cuts(t: Tables) -> DataFrame:
    """(f, start, stop) of all that goes: entries, places, references, associations and payloads."""
    going = t.gone.select("f", "item")
    entries = t.items.filter("label is not null").select("f", "start", "stop")
    places = t.places.filter("goes").select("f", "start", "stop").distinct()
    by = lambda df, c, name: df.join(wide(going.select("f", F.col("item").alias(c), F.lit(True).alias(name))), ["f", c], "left").withColumn(name, F.coalesce(name, F.lit(False)))
    told = by(by(t.references.filter("error is null"), "from_item", "source_goes"), "to_item", "target_goes")
    ref = told.groupBy("f", "ref").agg(F.min("start").alias("start"), F.min("stop").alias("stop"), F.bool_or("source_goes").alias("source_goes"), F.bool_and(F.col("target_goes") | F.col("slot").isNull()).alias("all_go")).withColumn("drops", F.col("source_goes") | F.col("all_go"))
    whole = ref.groupBy("f").agg(F.bool_and("drops").alias("none_left"))
    iref = t.boxes.filter("depth = 1 and kind = 'iref'").groupBy("f").agg(F.max_by(F.struct("start", "stop"), "ord").alias("x")).select("f", "x.start", "x.stop")
    lists = iref.join(wide(whole.filter("none_left").select("f")), "f")
    dropped = ref.filter("drops").join(wide(whole.filter("not none_left").select("f")), "f").select("f", "start", "stop")
    lost = told.join(wide(ref.filter("not drops").select("f", "ref")), ["f", "ref"]).filter("target_goes")
    first = F.col("start") + 8 + F.col("width") + 2
    slots = lost.select("f", (first + F.col("width") * F.col("slot")).alias("start"), (first + F.col("width") * (F.col("slot") + 1)).alias("stop"))
    linked = t.associations.filter("error is null").join(wide(going), ["f", "item"]).select("f", "start", "stop")
    union = intervals.merged(t.payloads(), "f").select("f", F.col("start").alias("x"), (F.col("start") + F.col("len")).alias("y"))
    held = union.join(wide(t.mdats().select("f", "data", "stop")), "f").select("f", F.greatest("x", "data").alias("start"), F.least("y", "stop").alias("stop")).filter("stop > start")
    every = entries
    for one in (places, lists, dropped, slots, linked, held):
        every = every.unionByName(one)
    return every.filter("stop > start")


def edits(t: Tables) -> DataFrame:
    """(f, start, stop, new): ranges and what stands there afterwards, in hex."""
    cut = stash(cuts(t), "cuts")
    out = [cut.withColumn("new", F.lit(""))]
    gone = cut.select("f", "start", (F.col("stop") - F.col("start")).alias("len"))
    put = lambda df, at, width, value: df.select("f", at.alias("start"), (at + width).alias("stop"), _be(value, width).alias("new"))
    # counts: entries, places, references, associations
    last = lambda kind: t.boxes.filter(f"depth = 1 and kind = '{kind}'").groupBy("f").agg(F.max_by("data", "ord").alias("data"))
    entries = t.items.filter("error is null").groupBy("f").agg(F.min("count_width").alias("width"), F.count("*").alias("n"), F.count("label").alias("lost")).join(wide(last("iinf")), "f")
    out.append(put(entries, F.col("data") + 4, F.col("width"), F.col("n") - F.col("lost")))
    places = t.places.groupBy("f").agg(F.count_distinct(F.when(~F.col("goes"), F.col("ord"))).alias("n")).join(wide(last("iloc")), "f")
    out.append(put(places, F.col("data") + 6, F.lit(2), F.col("n")))
    goes = t.gone.select("f", F.col("item").alias("to_item"), F.lit(1).alias("lost"))
    counted = t.references.filter("error is null").join(wide(goes), ["f", "to_item"], "left").groupBy("f", "ref").agg(F.min("start").alias("start"), F.min("width").alias("width"), F.min("from_item").alias("item"), F.count("*").alias("n"), F.count("lost").alias("lost"))
    partly = counted.filter("lost > 0 and lost < n").join(wide(t.gone.select("f", "item")), ["f", "item"], "left_anti")
    out.append(put(partly, F.col("start") + 8 + F.col("width"), F.lit(2), F.col("n") - F.col("lost")))
    linked = t.associations.filter("error is null").join(wide(t.gone.select("f", "item", F.lit(1).alias("lost"))), ["f", "item"], "left").groupBy("f", "box").agg(F.count("*").alias("n"), F.count("lost").alias("lost")).filter("lost > 0")
    out.append(put(linked, F.col("box") + 12, F.lit(4), F.col("n") - F.col("lost")))
    # sizes of boxes: what is cut between their first and last byte
    sized = t.boxes.filter("error is null and sized").select("f", "ord", "start", "data", "stop", "wide")
    upto = lambda df, at: intervals.removed_before(df, gone, "f", at).withColumnRenamed("removed", f"to_{at}")
    resized = stash(upto(upto(sized, "data"), "stop").withColumn("less", F.col("to_stop") - F.col("to_data")).filter("less > 0"), "resized")
    # boxes inside a range that goes as a whole need no size
    kept = resized.join(wide(intervals.contained(resized.select("f", "ord", "start", (F.col("stop") - F.col("start")).alias("len")), gone, "f").select("f", "ord")), ["f", "ord"], "left_anti")
    out.append(put(kept, F.col("start") + F.when(F.col("wide"), 8).otherwise(0), F.when(F.col("wide"), 8).otherwise(4), F.col("stop") - F.col("start") - F.col("less")))
    # places of what stays, re-based
    stays = t.places.filter("not goes")
    based = stays.filter("base_width > 0").select("f", "ord", "base_at", "base_width", F.col("base").alias("at")).distinct()
    moved = stash(intervals.rebased(based, gone, "f", 0), "bases")
    out.append(put(moved, F.col("base_at"), F.col("base_width"), F.col("moved")))
    held = stays.filter("extent is not null").select("f", "ord", F.col("at").alias("field"), F.col("offset_width").alias("width"), F.col("begin").alias("at"))
    placed = intervals.rebased(held, gone, "f", 0).join(wide(moved.select("f", "ord", F.col("moved").alias("new_base"))), ["f", "ord"], "left")
    out.append(put(placed, F.col("field"), F.col("width"), F.col("moved") - F.coalesce("new_base", F.lit(0))))
    every = out[0]
    for one in out[1:]:
        every = every.unionByName(one)
    return every


def spliced(content: Column, edit: Column) -> Column:
    """Content with an ordered array of edits (start, stop, new in hex) made."""
    between = lambda at, stop: F.hex(F.substring(content, (at + 1).cast("int"), (stop - at).cast("int")))
    before = lambda i: F.coalesce(F.get(edit, i - 1)["stop"], F.lit(0))
    heads = F.array_join(F.transform(edit, lambda e, i: F.concat(between(before(i), e["start"]), e["new"])), "")
    return F.unhex(F.concat(heads, between(F.element_at(edit, -1)["stop"], F.octet_length(content).cast("long"))))


def without_metadata(df: DataFrame, id_col: str, content_col: str = "content") -> DataFrame:
    """(id, outcome, removed, cleaned) of each HEIC file: outcomes and bytes of heic.heic_without_metadata(), by joins.

    Ids name files: non-null and unlike each other.  A file is written again only if every
    extent that stays holds the bytes that it held (compared()).
    """
    files = stash(df.select(F.col(id_col).alias("f"), F.coalesce(content_col, F.lit(b"")).alias("content")), "files")
    return rewritten(files, Tables(files)).withColumnRenamed("f", id_col)


def rewritten(files: DataFrame, t: Tables) -> DataFrame:
    """without_metadata() of written files (f, content), contents not null, and their tables."""
    told = stash(gates(t).withColumn("outcome", outcome()), "gates")
    lists = edits(t.only(told.filter("outcome = 'ok' and not plain").select("f"))).groupBy("f").agg(F.array_sort(F.collect_list(F.struct("start", "stop", "new"))).alias("edits"))
    lost = t.payloads().groupBy("f").agg(F.sum("len").alias("removed"))
    made = files.join(wide(told.select("f", "outcome")), "f").join(wide(lists), "f", "left").join(wide(lost), "f", "left")
    clean = F.when(F.col("outcome") == "ok", F.when(F.col("edits").isNull(), F.col("content")).otherwise(spliced(F.col("content"), F.col("edits"))))
    made = stash(made.select("f", "outcome", F.when(F.col("outcome") == "ok", F.coalesce("removed", F.lit(0))).alias("removed"), clean.alias("cleaned")), "cleaned")
    wrong = compared(t, made.filter("cleaned is not null").select("f", F.col("cleaned").alias("content"))).filter("not same").select("f").distinct().withColumn("bad", F.lit(True))
    last = made.join(wide(wrong), "f", "left").withColumn("outcome", F.when(F.col("bad"), "unsupported_layout").otherwise(F.col("outcome")))
    good = F.col("bad").isNull()
    return last.select("f", "outcome", F.when(good, F.col("removed")).alias("removed"), F.when(good, F.col("cleaned")).alias("cleaned"))


def compared(t: Tables, after: DataFrame) -> DataFrame:
    """(f, item, extent, same): for each extent that stays whether the written file has its bytes (full join of both files' places)."""
    held = lambda rows: rows.filter("extent is not null").select("f", "item", "extent", "size", "sha", "fits")
    then = held(t.places.filter("not goes").join(wide(after.select("f")), "f", "left_semi")).withColumnsRenamed({"size": "size_", "sha": "sha_", "fits": "fits_"})
    now = held(parts.heif_rows(after, "f", tables=("extents",)).select("f", "extents.*", "fits", "sha").filter("error is null"))
    same = (F.col("size") == F.col("size_")) & (F.col("sha") == F.col("sha_")) & F.col("fits") & F.col("fits_")
    return then.join(wide(now), ["f", "item", "extent"], "full").select("f", "item", "extent", F.coalesce(same, F.lit(False)).alias("same"))
