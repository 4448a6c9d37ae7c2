"""Chat formatting: layouts are told apart by a hash of their nested field paths.

The hashes of a record's nested field paths (without types) are its fingerprint.  Each
declarative mapping has the hashes of the paths it needs; of the mappings whose paths a
record has, with whatever beside them, that which needs most is taken, and turns prompt,
instruction and message layouts into one list of (role, text) turns.  Records without a
mapping are set apart and counted (rejects, reject_counts), never formatted.  The template marks turns with control strings and makes any
control string inside a text harmless, reversibly.  Everything is SQL functions.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomwork.llm.shared import free_name, let

#: Control strings of the template.
TURN, BODY, END = "<|turn|>", "<|text|>", "<|end|>\n"
#: What opens a control string, of this template or of others in use, and how it goes on; between the
#: two, escaping puts one backslash more.  No tail ends in an opening, so matches never overlap.
OPENING, TAIL = r"([<\[])(\\*)", r"(\||/?s>|/?INST\])"


@dataclass(frozen=True)
class Layout:
    """A sample record gives the field paths that are needed; ``turns`` lists (role, path), then come the items of ``arrays`` with role and text fields in them."""

    name: str
    sample: str
    turns: tuple[tuple[str, str], ...] = ()
    arrays: tuple[str, ...] = ()
    role: str = "$.role"
    text: str = "$.content"


LAYOUTS = (
    Layout("row", '{"role": "", "text": ""}', arrays=("row",), text="$.text"),
    Layout("messages", '{"messages": [{"role": "", "content": ""}]}', arrays=("$.messages",)),
    Layout("system_messages", '{"system": "", "messages": [{"role": "", "content": ""}]}', turns=(("system", "$.system"),), arrays=("$.messages",)),
    Layout("shared", '{"conversations": [{"from": "", "value": ""}]}', arrays=("$.conversations",), role="$.from", text="$.value"),
    Layout("system_shared", '{"system": "", "conversations": [{"from": "", "value": ""}]}', turns=(("system", "$.system"),), arrays=("$.conversations",), role="$.from", text="$.value"),
    Layout("prompt_turns", '{"prompt": [{"role": "", "content": ""}], "completion": [{"role": "", "content": ""}]}', arrays=("$.prompt", "$.completion")),
    Layout("instruction", '{"instruction": "", "output": ""}', turns=(("user", "$.instruction"), ("assistant", "$.output"))),
    Layout("instruction_input", '{"instruction": "", "input": "", "output": ""}', turns=(("user", "$.instruction"), ("user", "$.input"), ("assistant", "$.output"))),
    Layout("system_instruction", '{"system": "", "instruction": "", "output": ""}', turns=(("system", "$.system"), ("user", "$.instruction"), ("assistant", "$.output"))),
    Layout("system_instruction_input", '{"system": "", "instruction": "", "input": "", "output": ""}', turns=(("system", "$.system"), ("user", "$.instruction"), ("user", "$.input"), ("assistant", "$.output"))),
    Layout("no_messages", '{"messages": []}', arrays=("$.messages",)),
    Layout("no_shared", '{"conversations": []}', arrays=("$.conversations",)),
    Layout("prompt", '{"prompt": "", "completion": ""}', turns=(("user", "$.prompt"), ("assistant", "$.completion"))),
    Layout("prompt_response", '{"prompt": "", "response": ""}', turns=(("user", "$.prompt"), ("assistant", "$.response"))),
    Layout("context_question", '{"context": "", "question": "", "answer": ""}', turns=(("user", "$.context"), ("user", "$.question"), ("assistant", "$.answer"))),
    Layout("question", '{"question": "", "answer": ""}', turns=(("user", "$.question"), ("assistant", "$.answer"))),
)
#: Roles that layouts in use name otherwise.
ROLES = {"human": "user", "prompter": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}


#: Parts of a variant's schema text: a field's name, an opening, a closing, an array of nothing.
TOKEN = r"(?:`(?:[^`]|``)*`|\w+): |OBJECT<|ARRAY<|>|VOID|STRING"


def field_paths(record: Column, strings: bool = False) -> Column:
    """The nested field paths of a variant: a.b, a[].b, and a[]! for an array that is empty; or those of its ``strings``."""
    start = F.struct(F.array(F.lit("")).alias("open"), F.lit("").alias("at"), F.array().cast("array<string>").alias("found"))

    def step(acc: Column, token: Column) -> Column:
        named = F.concat(F.element_at(acc["open"], -1), F.regexp_replace(token, ": $", ""))
        here = F.when(token == "ARRAY<", F.concat(acc["at"], F.lit("[]"))).otherwise(acc["at"])
        moved = lambda opened, at, found: F.struct(opened.alias("open"), at.alias("at"), found.alias("found"))
        empty = (token == "VOID") & acc["at"].endswith("[]")
        if strings:
            return (
                F.when(token.endswith(": "), moved(acc["open"], named, acc["found"]))
                .when(token == ">", moved(F.slice(acc["open"], F.lit(1), F.size(acc["open"]) - 1), acc["at"], acc["found"]))
                .when(token == "VOID", acc)
                .when(token == "STRING", moved(acc["open"], acc["at"], F.concat(acc["found"], F.array(acc["at"]))))
                .otherwise(moved(F.concat(acc["open"], F.array(F.when(here == "", "").otherwise(F.concat(here, F.lit("."))))), here, acc["found"]))
            )
        return (
            F.when(token == "STRING", acc)
            .when(token.endswith(": "), moved(acc["open"], named, F.concat(acc["found"], F.array(named))))
            .when(token == ">", moved(F.slice(acc["open"], F.lit(1), F.size(acc["open"]) - 1), acc["at"], acc["found"]))
            .when(token == "VOID", moved(acc["open"], acc["at"], F.when(empty, F.concat(acc["found"], F.array(F.concat(acc["at"], F.lit("!"))))).otherwise(acc["found"])))
            .otherwise(moved(F.concat(acc["open"], F.array(F.when(here == "", "").otherwise(F.concat(here, F.lit("."))))), here, acc["found"]))
        )

    return F.aggregate(F.regexp_extract_all(F.schema_of_variant(record), F.lit(TOKEN), F.lit(0)), start, step, lambda acc: acc["found"])


def fingerprint(record: Column) -> Column:
    """Hashes of a record's field paths, in order."""
    return F.array_sort(F.transform(field_paths(record), lambda path: F.xxhash64(path)))


def shape(record: Column) -> Column:
    """One hash of a record's schema without types, so that records of a known shape need no list of paths."""
    return F.xxhash64(F.regexp_replace(F.schema_of_variant(record), r": (?!OBJECT<|ARRAY<)[A-Z]+(\([0-9, ]+\))?", ""))


def _pick(layout: Layout, record: Column) -> Column:
    turn = lambda role, text: F.struct(role.alias("role"), text.alias("text"))
    get = lambda v, path: F.try_variant_get(v, path, "string")
    if layout.arrays == ("row",):
        return F.array(turn(get(record, layout.role), get(record, layout.text)))
    items = lambda path: F.transform(F.try_variant_get(record, path, "array<variant>"), lambda v: turn(get(v, layout.role), get(v, layout.text)))
    parts = [F.array(*[turn(F.lit(r), get(record, p)) for r, p in layout.turns])] if layout.turns else []
    parts += [items(path) for path in layout.arrays]
    return F.concat(*parts) if len(parts) > 1 else parts[0]


def needed_paths(sample, at: str = "") -> list[str]:
    """The field paths of a parsed sample record, written as field_paths() writes them."""
    if isinstance(sample, dict):
        return [p for k, v in sample.items() for p in (at + k, *needed_paths(v, at + k + "."))]
    if isinstance(sample, list):
        here = at.removesuffix(".") + "[]"
        return needed_paths(sample[0], here + ".") if sample else [here + "!"]
    return []


def layout_number(record: Column, layouts: tuple[Layout, ...] = LAYOUTS) -> Column:
    """The place of the layout that a record has, null without one: by its whole shape, else by the paths it has."""
    needs = [needed_paths(json.loads(x.sample)) for x in layouts]
    # those that need most first, but an empty list never before a layout with text
    order = sorted(range(len(layouts)), key=lambda i: (any(p.endswith("!") for p in needs[i]), -len(needs[i]), i))

    def by_shape(own: Column) -> Column:
        found = F.lit(None).cast("int")
        for i in reversed(order):
            found = F.when(own == shape(F.parse_json(F.lit(layouts[i].sample))), F.lit(i)).otherwise(found)
        return found

    def by_paths(have: Column) -> Column:
        found = F.lit(None).cast("int")
        for i in reversed(order):
            found = F.when(F.size(F.array_except(F.array(*[F.xxhash64(F.lit(p)) for p in needs[i]]), have)) == 0, F.lit(i)).otherwise(found)
        return found

    return F.coalesce(let(shape(record), by_shape), let(fingerprint(record), by_paths))


def canonical_turns(df: DataFrame, record: Column, layouts: tuple[Layout, ...] = LAYOUTS, roles: dict[str, str] | None = None) -> DataFrame:
    """df with ``layout``, ``turns`` (array of role, text) and ``unformatted``, in place of columns of those names.

    ``record`` is a variant (parse_json, to_variant_object).  A record needs a layout's
    fields and may have others beside them; ``unformatted`` lists the paths of its strings
    that the layout does not format (see unformatted_counts).  Without a layout all three
    are null and the row stays (see rejects).  Null roles and texts become '', texts that
    are no strings their JSON text; an empty list of messages has no turns.  ``roles``
    gives other names of roles (ROLES by default).
    """
    at = free_name("__layout", *df.columns)
    numbered = df.withColumn(at, layout_number(record, layouts))
    name, turns = F.lit(None).cast("string"), F.lit(None).cast("array<struct<role:string,text:string>>")
    for i, layout in enumerate(layouts):
        mine = F.col(at) == i
        name, turns = F.when(mine, F.lit(layout.name)).otherwise(name), F.when(mine, _pick(layout, record)).otherwise(turns)
    pairs = [F.lit(x) for pair in (ROLES if roles is None else roles).items() for x in pair]
    known = lambda r: F.coalesce(F.create_map(*pairs)[r], r, F.lit("")) if pairs else F.coalesce(r, F.lit(""))
    clean = F.transform(turns, lambda t: F.struct(known(t["role"]).alias("role"), F.coalesce(t["text"], F.lit("")).alias("text")))
    told = [sorted(set(needed_paths(json.loads(x.sample)))) for x in layouts]
    listed = F.array(*[F.array(*map(F.lit, t)) for t in told])
    known_shape = F.array_contains(F.array(*[shape(F.parse_json(F.lit(x.sample))) for x in layouts]), shape(record))
    left = F.array_distinct(F.array_except(field_paths(record, strings=True), F.get(listed, F.col(at))))
    left = F.when(F.col(at).isNotNull(), F.when(known_shape, F.array().cast("array<string>")).otherwise(left))
    return numbered.withColumns({"layout": name, "turns": clean, "unformatted": left}).drop(at)


def rejects(turned: DataFrame) -> DataFrame:
    """The rows of canonical_turns() that no layout fits, whole."""
    return turned.filter(F.col("layout").isNull())


def unformatted_counts(turned: DataFrame) -> DataFrame:
    """(layout, path, n): how many records of a layout have a string at a path that is not formatted."""
    return turned.select("layout", F.explode("unformatted").alias("path")).groupBy("layout", "path").agg(F.count("*").alias("n"))


def reject_counts(turned: DataFrame, record: Column) -> DataFrame:
    """(paths, n): how many rejected records have which field paths."""
    return rejects(turned).groupBy(F.array_join(F.array_sort(field_paths(record)), " ").alias("paths")).agg(F.count("*").alias("n"))


def escape(text: Column) -> Column:
    return F.regexp_replace(text, F.lit(OPENING + TAIL), F.lit(r"$1$2\\$3"))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, F.lit(OPENING.replace(r"(\\*)", r"(\\*)\\") + TAIL), F.lit("$1$2$3"))


def format_turns(df: DataFrame, turns: str = "turns", trained: str = "assistant") -> DataFrame:
    """df with ``formatted`` and ``loss_spans``: the turn, and in it start and length in code points, of each text that is trained on.

    Rejected rows (null turns) have null in both.  Columns of those names are replaced.
    """
    name = free_name("__pieces", *df.columns)
    pieces = F.transform(turns, lambda t: F.struct(t["role"].alias("role"), F.concat(F.lit(TURN), escape(t["role"]), F.lit(BODY)).alias("head"), escape(t["text"]).alias("body")))
    held = df.withColumn(name, pieces)
    spans = F.transform(name, lambda p, i: F.struct(p["role"].alias("role"), i.alias("turn"), F.length(p["head"]).alias("start"), F.length(p["body"]).alias("length")))
    mask = F.transform(F.filter(spans, lambda x: x["role"] == trained), lambda x: F.struct(x["turn"].alias("turn"), x["start"].alias("start"), x["length"].alias("length")))
    return held.withColumn("formatted", F.array_join(F.transform(name, lambda p: F.concat(p["head"], p["body"], F.lit(END))), "")).withColumn("loss_spans", mask).drop(name)


def read_turns(formatted: Column) -> Column:
    """The turns of a formatted text, unescaped."""
    cut = F.split(formatted, r"<\|turn\|>|<\|text\|>|<\|end\|>\n", -1)

    def turns(c: Column) -> Column:
        at = F.when(F.size(c) > 1, F.sequence(F.lit(0), F.floor((F.size(c) - 4) / 3).cast("int"))).otherwise(F.array().cast("array<int>"))
        return F.transform(at, lambda i: F.struct(unescape(F.get(c, 3 * i + 1)).alias("role"), unescape(F.get(c, 3 * i + 2)).alias("text")))

    return let(cut, turns)


def read_loss(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped, in order."""
    cut = F.split(formatted, r"<\|end\|>\n", -1)
    read = lambda c: F.array_join(F.transform(spans, lambda s: unescape(F.substring(F.get(c, s["turn"]), s["start"] + 1, s["length"]))), "")
    return let(cut, read)


def gather(df: DataFrame, id_col: str = "conv_id", order_col: str = "turn") -> DataFrame:
    """One row of (id, turns) for each id, from rows that each hold a part in ``turns``; ties in order go by content, a null order comes first.

    The turns of one conversation become one value, as its formatted text is one value.
    """
    part = F.struct(F.col(order_col).alias("o"), F.col("turns").alias("t"))
    return df.groupBy(id_col).agg(F.flatten(F.transform(F.array_sort(F.collect_list(part)), lambda x: x["t"])).alias("turns"))
