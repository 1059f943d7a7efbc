"""Chat formatting: records of many layouts become one marked-up text for each conversation.

A record is a VARIANT. The tree of its nested field paths, without the types and
values below them, is hashed to a fingerprint; records of one layout share it. A
``Mapping`` declares which paths hold the conversation's id, the roles and the
texts, and by the fingerprints of its layout it is chosen for a record. Records
of no known layout come out of ``unmapped`` with their fingerprint, so that a
mapping can be declared for them. Only DataFrame functions run.

A ``Template`` sets marks around every turn. A mark inside a text gets a backslash
after its first character, one that has backslashes there already gets one more,
so no text holds a mark and taking one backslash away restores it. This is exact
because no mark starts with the end of another.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass, field
from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SCALAR = r"(STRING|BIGINT|DOUBLE|FLOAT|BOOLEAN|VOID|DATE|TIMESTAMP(_NTZ)?|BINARY|UUID|VARIANT|DECIMAL\(\d+,\d+\))(?=[,>]|$)"
TURNS = "array<struct<role string, text string>>"
PLAIN = re.compile(r"[A-Za-z_][A-Za-z0-9_]*")


@dataclass(frozen=True)
class Turn:
    """Where a turn's parts are: ``role`` is a path if ``role_path``, else the role itself.

    The texts at the paths ``text`` that are there are joined by an empty line.
    """

    role: str
    text: tuple[str, ...]
    role_path: bool = False


@dataclass(frozen=True)
class Mapping:
    """A layout. Paths are dotted names; ``each`` is the path of a list whose items have ``turns``.

    ``order`` orders records of one conversation. A record has all of ``paths`` and any of
    ``optional``; a path through a list is written ``list[].name``. ``roles`` renames roles.
    """

    name: str
    id: str
    turns: tuple[Turn, ...]
    paths: tuple[str, ...]
    optional: tuple[str, ...] = ()
    each: str | None = None
    order: str | None = None
    roles: dict[str, str] = field(default_factory=dict)


MESSAGES = Mapping(
    "messages", "id", (Turn("role", ("content",), True),),
    ("id", "messages[].role", "messages[].content"), ("messages[].name", "source"), each="messages",
)
SHARED = Mapping(
    "shared", "id", (Turn("from", ("value",), True),), ("id", "conversations[].from", "conversations[].value"),
    ("system",), each="conversations", roles={"human": "user", "gpt": "assistant"},
)
INSTRUCTION = Mapping(
    "instruction", "id", (Turn("system", ("system",)), Turn("user", ("instruction", "input")), Turn("assistant", ("output",))),
    ("id", "instruction", "output"), ("input", "system"),
)
PROMPT = Mapping(
    "prompt", "id", (Turn("user", ("prompt",)), Turn("assistant", ("completion",))), ("id", "prompt", "completion")
)
NESTED_PROMPT = Mapping(
    "nested_prompt", "meta.id", (Turn("user", ("data.prompt",)), Turn("assistant", ("data.response",))),
    ("meta.id", "data.prompt", "data.response"), ("meta.lang",),
)
TURN_ROWS = Mapping(
    "turn_rows", "conv_id", (Turn("role", ("text",), True),), ("conv_id", "turn", "role", "text"), order="turn"
)
MAPPINGS = (TURN_ROWS, MESSAGES, SHARED, INSTRUCTION, PROMPT, NESTED_PROMPT)


def skeleton(paths) -> str:
    """The tree of these paths, written as Spark writes the type of a VARIANT, with * for a leaf."""
    tree: dict = {}
    for path in paths:
        node, names = tree, path.split(".")
        for last, name in ((i == len(names) - 1, n) for i, n in enumerate(names)):
            node = node.setdefault(name, {}) if not last else node.setdefault(name, None) or node

    def text(node):
        parts = []
        for name in sorted(node):
            bare = name.removesuffix("[]")
            shown = bare if PLAIN.fullmatch(bare) else "`" + bare.replace("`", "``") + "`"
            inner = "*" if node[name] is None else text(node[name])
            parts.append(f"{shown}: " + (f"ARRAY<{inner}>" if bare != name else inner))
        return f"OBJECT<{', '.join(parts)}>"

    return text(tree)


def fingerprint_of(paths) -> str:
    return hashlib.sha256(skeleton(paths).encode()).hexdigest()


def fingerprints(mapping: Mapping) -> list[str]:
    """Of the layout with every choice of its optional paths."""
    return [
        fingerprint_of([*mapping.paths, *chosen])
        for n in range(len(mapping.optional) + 1)
        for chosen in combinations(mapping.optional, n)
    ]


def fingerprint(record: Column) -> Column:
    """Hash of a record's nested field paths."""
    return F.sha2(F.regexp_replace(F.schema_of_variant(record), SCALAR, "*"), 256)


def _at(record: Column, path: str, kind: str = "string") -> Column:
    steps = "".join("['" + step.replace("'", "\\'") + "']" for step in path.split("."))
    return F.try_variant_get(record, "$" + steps, kind)


def _turn(record: Column, turn: Turn, roles: dict[str, str]) -> Column:
    role = _at(record, turn.role) if turn.role_path else F.lit(turn.role)
    if turn.role_path and roles:
        role = reduce(lambda c, name: c.when(role == name, F.lit(roles[name])), roles, F.when(F.lit(False), "")).otherwise(role)
    parts = [_at(record, path) for path in turn.text]
    text = parts[0] if len(parts) == 1 else F.concat_ws("\n\n", *(F.when(p != "", p) for p in parts))
    return F.struct(F.coalesce(role, F.lit("")).alias("role"), F.coalesce(text, F.lit("")).alias("text"))


def _turns(record: Column, mapping: Mapping) -> Column:
    if mapping.each:
        items = F.coalesce(_at(record, mapping.each, "array<variant>"), F.array().cast("array<variant>"))
        return F.flatten(F.transform(items, lambda i: F.array(*(_turn(i, t, mapping.roles) for t in mapping.turns))))
    turns = F.array(*(_turn(record, t, mapping.roles) for t in mapping.turns))
    # a declared text whose optional path is missing is no turn
    there = F.array(*(F.lit(not _may_miss(t, mapping)) | _any(record, t) for t in mapping.turns))
    if not any(_may_miss(t, mapping) for t in mapping.turns):
        return turns
    marked = F.arrays_zip(turns.alias("turn"), there.alias("there"))
    return F.transform(F.filter(marked, lambda m: m["there"]), lambda m: m["turn"])


def _may_miss(turn: Turn, mapping: Mapping) -> bool:
    return all(path in mapping.optional for path in turn.text)


def _any(record: Column, turn: Turn) -> Column:
    return reduce(lambda a, b: a | b, (_at(record, path).isNotNull() for path in turn.text))


def canonical(records: DataFrame, record: str = "record", mappings: tuple[Mapping, ...] = MAPPINGS) -> DataFrame:
    """(fingerprint, layout, conversation, position, turns) of every record.

    ``record`` is a VARIANT column (``parse_json`` or ``to_variant_object``); other columns are left
    out. A null record or one of no known layout has a null layout and no turns. Null roles and
    texts become empty. ``conversation`` is the id as text; a null id is a conversation of its own.
    """
    value = F.col("_record")
    marked = records.select(F.col(record).alias("_record")).select(value, fingerprint(value).alias("fingerprint"))

    def choose(kind, part):
        cases = F.when(F.lit(False), F.lit(None).cast(kind))
        return reduce(lambda c, m: c.when(F.col("fingerprint").isin(fingerprints(m)), part(m)), mappings, cases)

    return marked.select(
        "fingerprint",
        choose("string", lambda m: F.lit(m.name)).alias("layout"),
        choose("string", lambda m: _at(value, m.id)).alias("conversation"),
        choose("bigint", lambda m: _at(value, m.order, "bigint") if m.order else F.lit(0).cast("bigint")).alias("position"),
        F.coalesce(choose(TURNS, lambda m: _turns(value, m).cast(TURNS)), F.array().cast(TURNS)).alias("turns"),
    )


def unmapped(canon: DataFrame) -> DataFrame:
    """(fingerprint, records) of the layouts that no mapping knows."""
    return canon.where("layout is null").groupBy("fingerprint").agg(F.count("*").alias("records"))


def conversations(canon: DataFrame) -> DataFrame:
    """(conversation, turns): the records of each conversation in order of position, then of role and text.

    A conversation is one training text, so all its turns meet in one row; repeated rows stay.
    """
    held = canon.where("layout is not null").groupBy("conversation")
    parts = held.agg(F.sort_array(F.collect_list(F.struct("position", "turns"))).alias("parts"))
    return parts.select("conversation", F.flatten(F.transform("parts", lambda p: p["turns"])).alias("turns"))


@dataclass(frozen=True)
class Template:
    """Marks before and after a turn by role; ``other`` is for roles without marks of their own.

    ``other`` has a mark before the role's name, one between it and the text, and one after the text.
    """

    roles: dict[str, tuple[str, str]]
    other: tuple[str, str, str]
    trained: tuple[str, ...] = ("assistant",)

    @property
    def marks(self) -> list[str]:
        return [m for pair in self.roles.values() for m in pair] + list(self.other)

    def __post_init__(self):
        marks = self.marks
        if len(set(marks)) < len(marks) or any(len(m) < 2 or "\\" in m for m in marks):
            raise ValueError("marks must be distinct, of two characters at least, and without a backslash")
        for a in marks:
            for b in marks:
                inside = a != b and a in b
                if inside or any(a.endswith(b[:n]) for n in range(1, min(len(a), len(b) + (a != b)))):
                    raise ValueError(f"marks overlap: {a} {b}")

    def _starts(self, slashes: str) -> str:
        """A mark's first character where the rest follows after backslashes."""
        rests: dict[str, list[str]] = {}
        for m in self.marks:
            rests.setdefault(m[0], []).append(re.escape(m[1:]))
        return "(" + "|".join(f"{re.escape(c)}(?={slashes}(?:{'|'.join(r)}))" for c, r in rests.items()) + ")"

    def escaped(self, text: Column) -> Column:
        return F.regexp_replace(text, F.lit(self._starts(r"\\*")), F.lit(r"$1\\"))

    def unescaped(self, text: Column) -> Column:
        return F.regexp_replace(text, F.lit(self._starts(r"\\+") + r"\\"), F.lit("$1"))

    @property
    def any_mark(self) -> str:
        return "|".join(re.escape(m) for m in self.marks)


INST = Template(
    {"system": ("<<SYS>>", "<</SYS>>"), "user": ("[INST]", "[/INST]"), "assistant": ("<s>", "</s>")},
    ("<|role|>", "<|text|>", "<|end|>"),
)


def segments(turns: Column, template: Template = INST) -> Column:
    """The formatted text in pieces (text, loss): marks and texts; loss is true for texts to train on."""

    def piece(text, loss=False):
        return F.struct(text.alias("text"), F.lit(loss).alias("loss"))

    def of(turn):
        role, text = turn["role"], template.escaped(turn["text"])
        before, between, after = (F.lit(m) for m in template.other)
        cases = F.when(F.lit(False), F.array(piece(F.lit(""))))
        for name, (start, end) in template.roles.items():
            own = F.array(piece(F.lit(start)), piece(text, name in template.trained), piece(F.lit(end)))
            cases = cases.when(role == name, own)
        named = [piece(before), piece(template.escaped(role)), piece(between)]
        trained = F.struct(text.alias("text"), role.isin(list(template.trained)).alias("loss"))
        return cases.otherwise(F.array(*named, trained, piece(after)))

    return F.flatten(F.transform(turns, of))


def formatted(convs: DataFrame, template: Template = INST) -> DataFrame:
    """``conversations`` as (conversation, segments, formatted): the pieces, and all of them as one text."""
    cut = convs.select("conversation", segments(F.col("turns"), template).alias("segments"))
    return cut.withColumn("formatted", F.array_join(F.transform("segments", lambda s: s["text"]), ""))


def read_turns(text: Column, template: Template = INST) -> Column:
    """The turns (role, text) that a formatted text holds."""
    marks = F.regexp_extract_all(text, F.lit(f"({template.any_mark})"), F.lit(1))
    pieces = F.split(text, template.any_mark, -1)
    between = template.other[1]
    opens = [start for start, _ in template.roles.values()] + [between]
    # each mark with the texts before and after it, split once
    steps = F.arrays_zip(marks.alias("mark"), pieces.alias("before"), F.slice(pieces, F.lit(2), F.size(marks)).alias("after"))

    def turn(step):
        role = F.when(step["mark"] == between, template.unescaped(step["before"]))
        for name, (start, _) in template.roles.items():
            role = role.when(step["mark"] == start, F.lit(name))
        return F.struct(role.alias("role"), template.unescaped(step["after"]).alias("text"))

    return F.transform(F.filter(steps, lambda step: F.coalesce(step["mark"].isin(opens), F.lit(False))), turn)


def loss_text(pieces: Column, template: Template = INST) -> Column:
    """All texts under the loss mask, unescaped, in order, with nothing between."""
    chosen = F.filter(pieces, lambda s: s["loss"])
    return F.array_join(F.transform(chosen, lambda s: template.unescaped(s["text"])), "")


def format_chats(
    records: DataFrame, record: str = "record", mappings: tuple[Mapping, ...] = MAPPINGS, template: Template = INST
) -> DataFrame:
    """(conversation, segments, formatted) of all records of known layouts; an empty table gives no row."""
    return formatted(conversations(canonical(records, record, mappings)), template)
