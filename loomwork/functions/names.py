"""Name sanitisers, page ranges and small text rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomwork.functions.matches import unicode_trim

# Characters that file names lose.
RESERVED = r'[/\\:*?"<>|\x{0}-\x{1F}\x{7F}-\x{9F}\x{200E}\x{200F}\x{202A}-\x{202E}\x{2066}-\x{2069}]'
SMALLER = r"[/\\\x{0}-\x{1F}\x{7F}\x{202A}-\x{202E}\x{2066}-\x{2069}]"
#: Pages that one range text may expand to.
MAX_PAGES = 2000


def download_name(base: Column, ext: str) -> Column:
    clean = unicode_trim(F.regexp_replace(F.coalesce(base, F.lit("")), RESERVED, ""))
    clean = F.when(clean == "", "Untitled").otherwise(clean)
    suffix = f".{ext}"
    clean = F.when((F.length(clean) > len(suffix)) & F.lower(clean).endswith(suffix), F.substring(clean, F.lit(1), F.length(clean) - len(suffix))).otherwise(clean)
    clean = F.regexp_replace(clean, "[. ]+$", "")
    device = clean.rlike(r"(?i)^(CON|PRN|AUX|NUL|COM\d|LPT\d)(\.|$)")
    return F.concat(F.when((clean == "") | device, "Untitled").otherwise(clean), F.lit(suffix))


def container_name(name: Column) -> Column:
    clean = F.substring(F.regexp_replace(F.coalesce(F.nullif(name, F.lit("")), F.lit("decrypted.bin")), RESERVED, "_"), 1, 200)
    return F.when(clean == "", "decrypted.bin").otherwise(clean)


def clean_base(name: Column) -> Column:
    base = F.regexp_replace(F.regexp_replace(F.coalesce(name, F.lit("")), r"\.[^.]*$", ""), SMALLER, "")
    return F.substring(F.when(base == "", "image").otherwise(base), 1, 120)


def marked_name(name: Column, ext: Column) -> Column:
    return F.concat(clean_base(name), F.lit("-wm."), ext)


def page_ranges(text: Column, pages: Column) -> Column:
    """(indices, over, many) of a range text; null if it cannot be read.

    The first token that fails decides; the size is known before anything is expanded.
    """
    tokens = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), "[,，;；]+"), unicode_trim), lambda t: t != "")
    span, single = r"^(\d*)\s*[-–—]\s*(\d*)$", r"^\d+$"
    part = lambda t, k, other: F.coalesce(F.regexp_extract(t, span, k).try_cast("long"), other)

    def read(t: Column) -> Column:
        whole = t.rlike(single)
        a = F.when(whole, t.try_cast("long")).when(t.rlike(span), part(t, 1, F.lit(1)))
        b = F.when(whole, t.try_cast("long")).when(t.rlike(span), part(t, 2, pages.cast("long")))
        return F.struct(a.alias("a"), b.alias("b"))

    kind = "struct<n:bigint,bad:boolean,over:bigint,many:boolean,got:array<struct<a:bigint,b:bigint>>>"
    start = F.from_json(F.lit('{"n":0,"bad":false,"many":false,"got":[]}'), kind)

    def step(acc: Column, x: Column) -> Column:
        stop = acc["bad"] | acc["many"] | acc["over"].isNotNull()
        bad = x["a"].isNull() | x["b"].isNull() | (x["a"] < 1) | (x["b"] < 1)
        over = F.when(x["a"] > pages, x["a"]).when(x["b"] > pages, x["b"])
        n = acc["n"] + F.abs(x["b"] - x["a"]) + 1
        fine = ~bad & over.isNull()
        return F.when(stop, acc).otherwise(
            F.struct(F.when(fine, n).otherwise(acc["n"]).alias("n"), bad.alias("bad"), F.when(~bad, over).alias("over"), (fine & (n > MAX_PAGES)).alias("many"), F.when(fine, F.concat(acc["got"], F.array(x))).otherwise(acc["got"]).alias("got"))
        )

    done = F.aggregate(F.transform(tokens, read), start, step)
    good = ~done["bad"] & done["over"].isNull() & ~done["many"]
    steps = F.flatten(F.transform(done["got"], lambda x: F.transform(F.sequence(x["a"], x["b"]), lambda p: (p - 1).cast("int"))))
    return F.when((F.size(tokens) > 0) & ~done["bad"], F.struct(F.when(good, steps).alias("indices"), done["over"].alias("over"), done["many"].alias("many")))


def rgb_fractions(colour: Column) -> Column:
    return F.transform(F.array(F.lit(2), F.lit(4), F.lit(6)), lambda at: F.conv(F.substring(colour, at, F.lit(2)), 16, 10).cast("double") / 255)
