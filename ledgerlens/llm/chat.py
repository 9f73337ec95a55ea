"""Chat formatting by schema fingerprints, in DataFrame functions only.

Records of different layouts (lists of messages, prompt and answer, instruction and output,
rows of turns) become one canonical array of turns. For each record, the known field paths
that it holds are sorted and hashed; the hash picks a declarative mapping. A layout names the
paths that it needs and those that it may have besides, so it has a hash for each choice of
these. ``format_turns`` then writes the turns in a ChatML-like template with an exact inverse,
``parse_formatted``.

Paths: ``messages`` is a list that is there, ``messages[]`` one with an item, and
``messages[].role`` one in which any item has that field. In JSON and variant records a field
with a null is there; in structs, where an absent field is a null too, it is not.

Defined results: a null text or role counts as empty, and a null system text is no turn; an
empty list has no turns; where a record has both a list and a ``prompt`` (the list's first
turn, in data of this kind), the list counts; a record of no known layout, or with a list of
other items than objects, gets null turns and the layout ``unknown``; a conversation without
turns formats to an empty string; turns of equal number are ordered by role and text, and
repeated rows stay; extra columns are ignored. A conversation is one output row, so one row
holds all its text.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass
from itertools import chain, combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructType, VariantType

START, END = "<|im_start|>", "<|im_end|>"
TURNS = "array<struct<role:string,text:string>>"


@dataclass(frozen=True)
class Layout:
    """A mapping: the field paths that identify it, and where turns come from."""

    name: str
    #: paths that must be there
    paths: tuple[str, ...] = ()
    #: paths that may be there, too
    optional: tuple[str, ...] = ()
    #: of a list of turns: the list, and the fields of role and text
    items: tuple[str, str, str] | None = None
    #: of single fields: pairs of role and path, in order, each a turn
    fields: tuple[tuple[str, str], ...] = ()
    #: the path of a text that comes first, where it is not null
    system: str = "system"

    def choices(self) -> list[frozenset[str]]:
        """Every set of paths that is this layout."""
        must = [frozenset(self.paths)]
        if self.items:
            name, *keys = self.items
            held = [frozenset(), *(frozenset([f"{name}[]", *some]) for some in _subsets([f"{name}[].{k}" for k in keys]) if some)]
            must = [frozenset([name]) | x for x in held]
        return [m | frozenset(more) for m in must for more in _subsets(self.optional)]


def _subsets(names) -> list[tuple[str, ...]]:
    return list(chain.from_iterable(combinations(names, n) for n in range(len(names) + 1)))


#: lists of turns, and the names of role and text in them
LISTS = ("turns", "messages", "conversations", "conversation")
ITEMS = (("role", "content"), ("role", "text"), ("from", "value"), ("speaker", "text"))
LAYOUTS = (
    *(Layout(name, items=(name, role, text), optional=("system", "prompt")) for name in LISTS for role, text in ITEMS),
    Layout("system_prompt_response", ("system", "prompt", "response"), fields=(("user", "prompt"), ("assistant", "response"))),
    Layout("prompt_completion", ("completion",), ("prompt", "system"), fields=(("user", "prompt"), ("assistant", "completion"))),
    Layout("prompt_response", ("response",), ("prompt", "system"), fields=(("user", "prompt"), ("assistant", "response"))),
    Layout("prompt", ("prompt",), ("system",), fields=(("user", "prompt"),)),
    Layout("instruction_input_output", ("instruction", "input", "output"), ("system",), fields=(("user", "instruction\ninput"), ("assistant", "output"))),
    Layout("instruction_output", ("output",), ("instruction", "input", "system"), fields=(("user", "instruction\ninput"), ("assistant", "output"))),
    Layout("instruction", ("instruction",), ("input", "system"), fields=(("user", "instruction\ninput"),)),
    Layout("question_answer", ("answer",), ("question", "system"), fields=(("user", "question"), ("assistant", "answer"))),
    Layout("question", ("question",), ("system",), fields=(("user", "question"),)),
)
#: the mark of a list with an item that is no object; no layout has it
OTHER = ".?"
#: other names of roles, as found in the layouts above
ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}


def fingerprint_of(paths) -> str:
    """The hash of a set of field paths."""
    return hashlib.sha256("\n".join(sorted(paths)).encode()).hexdigest()


def fingerprints(layouts: tuple[Layout, ...]) -> list[list[str]]:
    """The hashes of each layout; one that several have is the first's."""
    seen, out = set(), []
    for layout in layouts:
        own = [h for h in dict.fromkeys(map(fingerprint_of, layout.choices())) if h not in seen]
        seen.update(own)
        out.append(own)
    return out


def _vocabulary(layouts: tuple[Layout, ...]) -> list[str]:
    paths = {p for layout in layouts for choice in layout.choices() for p in choice}
    return sorted(paths | {f"{layout.items[0]}[]{OTHER}" for layout in layouts if layout.items})


def _at(schema: StructType, path: str):
    """The type at a path like ``messages[].role`` in a schema, or None."""
    at = schema
    for part in path.split("."):
        name, listed = (part[:-2], True) if part.endswith("[]") else (part, False)
        if not isinstance(at, StructType) or name not in at.fieldNames():
            return None
        at = at[name].dataType
        if listed:
            if not isinstance(at, ArrayType):
                return None
            at = at.elementType
    return at


def _present(record: Column, kind, path: str, lists: set[str]) -> Column:
    """Whether the record holds the path."""
    name, inside, key = path.partition("[]")
    if isinstance(kind, VariantType):
        if name not in lists:
            return F.try_variant_get(record, f"$.{name}", "variant").isNotNull()
        items = F.try_variant_get(record, f"$.{name}", "array<variant>")
        if key == OTHER:
            held = lambda i: ~F.startswith(F.schema_of_variant(i), F.lit("OBJECT"))
        else:
            held = lambda i: F.try_variant_get(i, f"$.{key[1:]}", "variant").isNotNull()
    else:
        if _at(kind, path) is None or (name in lists and not isinstance(_at(kind, name), ArrayType)):
            return F.lit(False)
        items = record[name]
        held = lambda i: i[key[1:]].isNotNull()
    if not inside:
        return items.isNotNull()
    return F.coalesce(F.exists(items, held) if key else F.size(items) > 0, F.lit(False))


def _text(record: Column, kind, path: str) -> Column:
    """The text of single fields; several, joined by line breaks, leave out empty ones."""
    parts = []
    for p in path.split("\n"):
        if isinstance(kind, VariantType):
            parts.append(F.try_variant_get(record, f"$.{p}", "string"))
        else:
            parts.append(record[p].cast("string") if _at(kind, p) is not None else F.lit(None).cast("string"))
    return parts[0] if len(parts) == 1 else F.concat_ws("\n", *[F.when(p != "", p) for p in parts])


def _turns(record: Column, kind, layout: Layout) -> Column:
    if layout.items:
        name, role, text = layout.items
        if isinstance(kind, VariantType):
            items = F.try_variant_get(record, f"$.{name}", f"array<struct<`{role}`:string,`{text}`:string>>")
        elif _at(kind, f"{name}[]") is None or not isinstance(_at(kind, f"{name}[]"), StructType):
            return F.lit(None).cast(TURNS)
        else:
            items = record[name]
        of = lambda t, key: t[key].cast("string") if isinstance(kind, VariantType) or _at(kind, f"{name}[].{key}") is not None else F.lit(None).cast("string")
        turns = F.transform(items, lambda t: F.struct(_role(of(t, role)).alias("role"), F.coalesce(of(t, text), F.lit("")).alias("text")))
    else:
        turns = F.array(*[F.struct(F.lit(r).alias("role"), F.coalesce(_text(record, kind, p), F.lit("")).alias("text")) for r, p in layout.fields])
    if layout.system not in (*layout.paths, *layout.optional) or not isinstance(kind, VariantType) and _at(kind, layout.system) is None:
        return turns
    said = _text(record, kind, layout.system)
    first = F.array(F.struct(F.lit("system").alias("role"), said.alias("text"))).cast(TURNS)
    return F.when(said.isNull(), turns.cast(TURNS)).otherwise(F.concat(first, turns.cast(TURNS)))


def _role(role: Column) -> Column:
    out = F.coalesce(role, F.lit(""))
    for other, name in ROLES.items():
        out = F.when(role == other, F.lit(name)).otherwise(out)
    return out


def canonical_turns(df: DataFrame, record: str, layouts: tuple[Layout, ...] = LAYOUTS) -> DataFrame:
    """Add ``fingerprint``, ``layout`` and ``turns`` from a struct, variant or JSON column."""
    kind, col = df.schema[record].dataType, F.col(f"`{record}`")
    if isinstance(kind, StringType):
        col, kind = F.try_parse_json(col), VariantType()
    lists = {x.items[0] for x in layouts if x.items}
    held = F.array_compact(F.array(*[F.when(_present(col, kind, p, lists), F.lit(p)) for p in _vocabulary(layouts)]))
    df = df.withColumn("fingerprint", F.sha2(F.array_join(held, "\n"), 256))
    layout, turns = F.lit(None).cast("string"), F.lit(None).cast(TURNS)
    for x, hashes in reversed(list(zip(layouts, fingerprints(layouts)))):
        if not isinstance(kind, VariantType) and any(_at(kind, p) is None for p in (*x.paths, *(x.items or ())[:1])):
            continue  # no record of this type has it
        fits = F.col("fingerprint").isin(hashes)
        layout = F.when(fits, F.lit(x.name)).otherwise(layout)
        turns = F.when(fits, _turns(col, kind, x).cast(TURNS)).otherwise(turns)
    df = df.withColumn("turns", turns)
    return df.withColumn("layout", F.coalesce(F.when(F.col("turns").isNotNull(), layout), F.lit("unknown")))


def records_from_rows(df: DataFrame, key: str = "conv_id", order: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One record ``turns`` a conversation, from a table with a row for each turn."""
    turn = F.struct(F.col(order).alias("n"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    listed = F.array_sort(F.collect_list(turn))
    bare = F.transform(listed, lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))
    return df.groupBy(key).agg(F.struct(bare.alias("turns")).alias("record"))


def escape(text: Column) -> Column:
    """Put one more backslash between ``<`` and ``|``, so that no control string is left."""
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescape(text: Column) -> Column:
    """The inverse of escape."""
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def _escape_role(role: Column) -> Column:
    return escape(F.replace(F.replace(role, F.lit("%"), F.lit("%25")), F.lit("\n"), F.lit("%0A")))


def _unescape_role(role: Column) -> Column:
    return F.replace(F.replace(unescape(role), F.lit("%0A"), F.lit("\n")), F.lit("%25"), F.lit("%"))


def format_turns(df: DataFrame, turns: str = "turns", loss_role: str = "assistant") -> DataFrame:
    """Add ``formatted`` and ``loss_mask``.

    The mask lists runs of characters of ``formatted`` in order, three for each turn (head,
    text, tail); ``loss`` marks those that the loss covers: the texts of ``loss_role``.
    """
    parts = F.transform(
        F.col(turns),
        lambda t: F.struct(
            F.concat(F.lit(START), _escape_role(t["role"]), F.lit("\n")).alias("head"),
            escape(t["text"]).alias("body"),
            (t["role"] == loss_role).alias("loss"),
        ),
    )
    tail = END + "\n"
    run = lambda loss, chars: F.struct(loss.alias("loss"), chars.cast("long").alias("chars"))
    return (
        df.withColumn("_parts", parts)
        .withColumn("formatted", F.array_join(F.transform("_parts", lambda p: F.concat(p["head"], p["body"], F.lit(tail))), ""))
        .withColumn("loss_mask", F.flatten(F.transform("_parts", lambda p: F.array(run(F.lit(False), F.length(p["head"])), run(p["loss"], F.length(p["body"])), run(F.lit(False), F.lit(len(tail)))))))
        .drop("_parts")
    )


def parse_formatted(formatted: Column) -> Column:
    """The turns of a formatted string, with texts as they were."""
    blocks = F.split(formatted, r"<\|im_end\|>\n", -1)
    blocks = F.slice(blocks, F.lit(1), F.size(blocks) - 1)
    at = lambda b: F.instr(b, "\n")
    return F.transform(
        blocks,
        lambda b: F.struct(
            _unescape_role(F.substring(b, F.lit(len(START) + 1), at(b) - len(START) - 1)).alias("role"),
            unescape(F.substring(b, at(b) + 1, F.length(b))).alias("text"),
        ),
    )


def loss_text(turns: Column, mask: Column) -> Column:
    """All text under the mask, unescaped; turns as read by parse_formatted."""
    flags = F.filter(mask, lambda m, i: i % 3 == 1)
    kept = F.filter(F.zip_with(turns, flags, lambda t, m: F.when(m["loss"], t["text"])), lambda t: t.isNotNull())
    return F.array_join(kept, "")
