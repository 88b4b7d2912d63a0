"""Chat formatting by schema fingerprints.

A record's fingerprint is the hash of the set of its nested field paths (messages[].role, instruction, ...).  The fingerprint
selects one of the declarative MAPPINGS, which says where the turns of such a layout stand; records of all layouts become the
same canonical turns of a role and a text, and those are rendered by one template.  A worker chooses the mapping of a
fingerprint once, however many records have it; the paths themselves are compared too, so that no collision is trusted.

Defined cases: a record that is null, isn't a JSON object, is nested deeper than DEPTH or fits no mapping has a null layout and
chat and no turns.  Halves of surrogate pairs that a record has by escapes become the replacement character.  Turns
whose text is null or empty are left out; a record without any turn left has an empty chat.  Roles are mapped by ROLES, and
unknown or missing roles become user.  The template's own marks in a text are broken up, so that text can't open or close a
turn.  Fields that no mapping names do no harm, but change the fingerprint.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, slices

DEPTH = 100
_HALVES = re.compile("[\ud800-\udfff]")

ROLES = {"system": "system", "developer": "system", "user": "user", "human": "user", "prompter": "user", "question": "user", "assistant": "assistant", "gpt": "assistant", "bot": "assistant", "chatgpt": "assistant", "model": "assistant", "answer": "assistant", "tool": "tool", "function": "tool", "observation": "tool"}


@dataclass(frozen=True)
class Mapping:
    """Where a layout has its turns: either a list of records (turns, role, text), a list of texts that alternate, or fields with a
    role each.  root is the path of the object that holds all of it; fields of one role that follow one another are joined."""

    name: str
    turns: str = ""
    role: str = ""
    text: str = ""
    fields: tuple[tuple[str, str], ...] = ()
    optional: frozenset[str] = frozenset()
    root: tuple[str, ...] = ()
    before: tuple[tuple[str, str], ...] = field(default=())

    def required(self) -> set[str]:
        base = "".join(f"{r}." for r in self.root)
        if self.fields:
            return {base + p for _, p in self.fields if p not in self.optional}
        return {f"{base}{self.turns}[]" + (f".{x}" if x else "") for x in ((self.role, self.text) if self.text else ("",))}


def _layouts(root: tuple[str, ...], tag: str) -> list[Mapping]:
    return [
        Mapping(f"{tag}messages", "messages", "role", "content", root=root, before=(("system", "system"),)),
        Mapping(f"{tag}messages-text", "messages", "role", "text", root=root, before=(("system", "system"),)),
        Mapping(f"{tag}turns", "turns", "role", "text", root=root),
        Mapping(f"{tag}turns-content", "turns", "role", "content", root=root),
        Mapping(f"{tag}conversations", "conversations", "from", "value", root=root, before=(("system", "system"),)),
        Mapping(f"{tag}conversation", "conversation", "role", "content", root=root, before=(("system", "system"),)),
        Mapping(f"{tag}dialog", "dialog", root=root),
        Mapping(f"{tag}instruction", fields=(("system", "system"), ("user", "instruction"), ("user", "input"), ("assistant", "output")), optional=frozenset({"system", "input"}), root=root),
        Mapping(f"{tag}instruction-response", fields=(("system", "system"), ("user", "instruction"), ("user", "context"), ("assistant", "response")), optional=frozenset({"system", "context"}), root=root),
        Mapping(f"{tag}preference", fields=(("system", "system"), ("user", "prompt"), ("assistant", "chosen")), optional=frozenset({"system"}), root=root),
        Mapping(f"{tag}prompt-completion", fields=(("system", "system"), ("user", "prompt"), ("assistant", "completion")), optional=frozenset({"system"}), root=root),
        Mapping(f"{tag}prompt-response", fields=(("system", "system"), ("user", "prompt"), ("assistant", "response")), optional=frozenset({"system"}), root=root),
        Mapping(f"{tag}question-answer", fields=(("system", "system"), ("user", "context"), ("user", "question"), ("assistant", "answer")), optional=frozenset({"system", "context"}), root=root),
    ]


#: In order of preference.
MAPPINGS = (*_layouts((), ""), *_layouts(("data",), "data-"), *_layouts(("conversation",), "conversation-"))


def paths(value) -> set[str] | None:
    """The nested field paths of a record; [] stands for the elements of a list.  None of a record nested deeper than DEPTH."""
    found: set[str] = set()
    left = [(value, "", 0)]
    while left:
        value, at, depth = left.pop()
        if depth > DEPTH:
            return None
        inner = ((f"{at}.{k}" if at else k, v) for k, v in value.items()) if isinstance(value, dict) else ((f"{at}[]", v) for v in value) if isinstance(value, list) else ()
        for path, v in inner:
            found.add(path)
            if isinstance(v, (dict, list)):
                left.append((v, path, depth + 1))
    return found


def fingerprint(found: set[str]) -> int:
    return xxhash.xxh3_64_intdigest("\n".join(sorted(found)).encode("utf-8", "surrogatepass"))


def choose(found: set[str], mappings=MAPPINGS) -> Mapping | None:
    return next((m for m in mappings if m.required() <= found), None)


def _text(value) -> str:
    """A text, or the texts of a list of content parts; numbers and booleans as JSON."""
    if value is None:
        return ""
    if isinstance(value, str):
        return value
    if isinstance(value, list):
        return "".join(_text(v.get("text") if isinstance(v, dict) else v) for v in value)
    return json.dumps(value, ensure_ascii=False, sort_keys=True)


def _role(value) -> str:
    return ROLES.get(value.lower() if isinstance(value, str) else "", "user")


def canonical(record: dict, mapping: Mapping) -> list[tuple[str, str]]:
    """(role, text) turns of a record that fits the mapping."""
    for key in mapping.root:
        record = record[key]
    out: list[tuple[str, str]] = []
    for role, key in mapping.fields or mapping.before:
        text = _text(record.get(key)) if not isinstance(record.get(key), (list, dict)) or mapping.fields else ""
        if text and out and out[-1][0] == role:
            out[-1] = (role, f"{out[-1][1]}\n\n{text}")
        elif text:
            out.append((role, text))
    for k, turn in enumerate((record.get(mapping.turns) or []) if mapping.turns else []):
        if isinstance(turn, dict):
            out.append((_role(turn.get(mapping.role)), _text(turn.get(mapping.text))))
        elif not mapping.text:
            out.append(("assistant" if k % 2 else "user", _text(turn)))
    return [(r, t) for r, t in out if t]


def render(turns: list[tuple[str, str]]) -> str:
    chat = "".join(f"<|im_start|>{r}\n{t.replace('<|im_', '< |im_')}<|im_end|>\n" for r, t in turns)
    return chat if chat.isascii() else _HALVES.sub("\ufffd", chat)


def format_chats(records: DataFrame, key: str, column: str) -> DataFrame:
    """Rows (key, layout, n_turns, chat) for every record, a JSON text in the named column."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chosen: dict[int, tuple[set[str], Mapping | None]] = {}
        for part in slices(batches):
            out = []
            for text in part["record"]:
                try:
                    record = json.loads(text) if text else None
                except (ValueError, RecursionError):
                    record = None
                mapping = None
                if isinstance(record, dict) and (found := paths(record)) is not None:
                    f = fingerprint(found)
                    if f not in chosen or chosen[f][0] != found:
                        if len(chosen) > 10_000:
                            chosen.clear()
                        chosen[f] = found, choose(found)
                    mapping = chosen[f][1]
                turns = canonical(record, mapping) if mapping else []
                out.append((mapping.name if mapping else None, len(turns), render(turns) if mapping else None))
            yield pa.RecordBatch.from_arrays([pa.array(part[key], kind), pa.array([r[0] for r in out], pa.string()), pa.array([r[1] for r in out], pa.int32()), pa.array([r[2] for r in out], pa.string())], [key, "layout", "n_turns", "chat"])

    kind = pa.int64()
    return lean(records).select(F.col(key).cast("long").alias(key), F.col(column).alias("record")).mapInArrow(run, f"`{key}` long, layout string, n_turns int, chat string")


#: What conversation_records() lays the turns out as, in the order of conv_id modulo their number.
LAID_OUT = ("turns", "messages", "conversations", "data-messages-text", "conversation-turns-content", "conversation")


def conversation_records(turns: DataFrame) -> DataFrame:
    """(conv_id, record) of a table with a row for every turn (conv_id, turn, role, text).  Turns of one number, repeated rows among
    them, follow one another in the order of role and text.  Rows without conv_id belong to no conversation.  As sources differ
    in their layouts, so do the records, by conv_id: LAID_OUT."""
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", "role", "text").where("conv_id IS NOT NULL")
    listed = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("t"))

    def named(role: str, text: str):
        return F.transform("t", lambda x: F.struct(x["role"].alias(role), x["text"].alias(text)))

    records = (
        F.struct("conv_id", F.col("t").alias("turns")),
        F.struct(named("role", "content").alias("messages"), F.col("conv_id").alias("id")),
        F.struct(named("from", "value").alias("conversations")),
        F.struct(F.struct(named("role", "text").alias("messages")).alias("data"), F.lit("x").alias("source")),
        F.struct(F.struct(named("role", "content").alias("turns"), F.size("t").alias("n")).alias("conversation")),
        F.struct(named("role", "content").alias("conversation")),
    )
    which, record = F.pmod("conv_id", F.lit(len(records))), F.lit(None).cast("string")
    for k, r in enumerate(records):
        record = F.when(which == k, F.to_json(r, {"ignoreNullFields": "false"})).otherwise(record)
    return listed.select("conv_id", record.alias("record"))
