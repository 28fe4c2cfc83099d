"""Chat formatting: schema fingerprints choose declarative mappings to canonical turns.

A record is a JSON object of any known layout.  Its fingerprint is a hash of its sorted nested field
paths (array elements share one path).  Each layout is one ``Mapping``; the fingerprints of all its
combinations of optional fields lead to it, so choosing a mapping is one dictionary probe.  A record with
other fields besides goes to the mapping of most required paths among those that it holds, remembered
by its paths; what is left is counted by fingerprint (``unknown_layouts``).  The
template writes a turn as ``<|role|>``, newline, text, ``<|end|>``, newline.  Inside texts and roles
``<|`` is escaped by a backslash (and ``<\\|`` by one more), which unescaping undoes exactly, so no
text can forge a marker.  The loss mask covers assistant texts.

Defined cases: a null record, invalid JSON or an unknown layout gives no turns, an empty string and a
null mapping (the row stays); null texts and roles are empty; a conversation without rows does not
exist; turns with equal numbers are ordered by role, then text, and repeated rows are all kept; texts
of any length are kept whole; an empty table gives an empty result; extra columns of rows are not read.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from hashlib import blake2b
from itertools import combinations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import slices

ASSISTANT = "assistant"
#: Names of roles in other layouts (fixed values).
ROLES = {"human": "user", "prompter": "user", "instruction": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant", "chatbot": "assistant", "ai": "assistant"}


@dataclass(frozen=True)
class Mapping:
    """``each``: path of a list of turns with role and text fields; ``fields``: (role, field) in order;
    ``renames``: the layout has names of its own for roles (``ROLES``); in others a role stays as it is."""

    name: str
    required: tuple[str, ...]
    optional: tuple[str, ...] = ()
    each: str = ""
    role: str = ""
    text: str = ""
    fields: tuple[tuple[str, str], ...] = ()
    renames: bool = False


#: A user turn of several fields joins the non-empty ones by a blank line.
MAPPINGS = (
    Mapping("messages", ("messages[].role", "messages[].content"), ("messages[].turn", "messages[].name", "id"), "messages", "role", "content"),
    Mapping("messages-parts", ("messages[].role", "messages[].content[].type", "messages[].content[].text"), ("id",), "messages", "role", "content"),
    Mapping("share", ("conversations[].from", "conversations[].value"), ("id", "system"), "conversations", "from", "value", (("system", "system"),), renames=True),
    Mapping("turns", ("turns[].speaker", "turns[].text"), ("id",), "turns", "speaker", "text", renames=True),
    Mapping("dialog", ("dialog[].role", "dialog[].text"), ("id",), "dialog", "role", "text"),
    Mapping("instruction", ("instruction", "output"), ("input", "system", "id"), fields=(("system", "system"), ("user", "instruction"), ("user", "input"), ("assistant", "output"))),
    Mapping("instruction-response", ("instruction", "response"), ("context", "category", "system", "id"), fields=(("system", "system"), ("user", "context"), ("user", "instruction"), ("assistant", "response"))),
    Mapping("prompt", ("prompt", "completion"), ("system", "id"), fields=(("system", "system"), ("user", "prompt"), ("assistant", "completion"))),
    Mapping("prompt-response", ("prompt", "response"), ("system", "id"), fields=(("system", "system"), ("user", "prompt"), ("assistant", "response"))),
    Mapping("question", ("question", "answer"), ("context", "system", "id"), fields=(("system", "system"), ("user", "context"), ("user", "question"), ("assistant", "answer"))),
)


def paths(value: object, at: str = "") -> Iterator[str]:
    """Nested field paths; an empty or scalar value ends a path."""
    if isinstance(value, dict) and value:
        for k, v in value.items():
            yield from paths(v, f"{at}.{k}" if at else k)
    elif isinstance(value, list) and value:
        for v in value:
            yield from paths(v, f"{at}[]")
    else:
        yield at


def fingerprint(found: set[str] | frozenset[str]) -> str:
    return blake2b("\n".join(sorted(found)).encode(), digest_size=8).hexdigest()


@lru_cache(1)
def known() -> dict[str, Mapping]:
    out: dict[str, Mapping] = {}
    for m in MAPPINGS:
        for n in range(len(m.optional) + 1):
            for extra in combinations(m.optional, n):
                out.setdefault(fingerprint({*m.required, *extra}), m)
    return out


@lru_cache(4096)
def nearest(found: frozenset[str]) -> Mapping | None:
    """The mapping for paths with others among them: of those whose required paths are all there the one with
    most, the first of equals."""
    fitting = [m for m in MAPPINGS if found.issuperset(m.required)]
    return max(fitting, key=lambda m: len(m.required), default=None)


def _text(value: object) -> str:
    if isinstance(value, list):  # parts of one content
        return "".join(_text(x.get("text") if isinstance(x, dict) else x) for x in value)
    return "" if value is None else value if isinstance(value, str) else json.dumps(value, ensure_ascii=False)


def _role(value: object, renames: bool) -> str:
    said = _text(value)
    return ROLES.get(said.lower(), said) if renames else said


def canonical(record: str | None) -> tuple[str | None, str | None, list[tuple[str, str]]]:
    """(fingerprint, mapping name, turns) of one JSON record."""
    try:
        value = json.loads(record) if record else None
    except ValueError:
        value = None
    if not isinstance(value, dict):
        return None, None, []
    found = frozenset(paths(value))
    mark = fingerprint(found)
    mapping = known().get(mark) or nearest(found)
    if mapping is None:
        return mark, None, []
    turns: list[tuple[str, str]] = []
    for role, field in mapping.fields:
        said = _text(value.get(field))
        if field in value and (said or field in mapping.required):
            if role == "user" and turns and turns[-1][0] == "user":
                turns[-1] = (role, f"{turns[-1][1]}\n\n{said}")
            else:
                turns.append((role, said))
    for x in value.get(mapping.each, ()) if mapping.each else ():
        # An element that is no object has no role, and is its text.
        turns.append((_role(x.get(mapping.role), mapping.renames), _text(x.get(mapping.text))) if isinstance(x, dict) else ("", _text(x)))
    return mark, mapping.name, turns


_ESCAPE, _UNESCAPE = re.compile(r"<(\\*)\|"), re.compile(r"<\\(\\*)\|")


def escape(text: str) -> str:
    return _ESCAPE.sub(r"<\\\1|", text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"<\1|", text)


def render(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The formatted text and the loss mask: ranges of its code points."""
    out, at, mask = [], 0, []
    for role, text in turns:
        head, body = f"<|{escape(role).replace('%', '%25').replace('|>', '%7C>')}|>\n", escape(text)
        if role == ASSISTANT:
            mask.append((at + len(head), at + len(head) + len(body)))
        out += [head, body, "<|end|>\n"]
        at += len(head) + len(body) + len("<|end|>\n")
    return "".join(out), mask


_TURN = re.compile(r"<\|(.*?)\|>\n(.*?)<\|end\|>\n", re.S)


def parse(formatted: str) -> list[tuple[str, str]]:
    """The turns of a formatted text."""
    return [(unescape(m[1].replace("%7C>", "|>").replace("%25", "%")), unescape(m[2])) for m in _TURN.finditer(formatted)]


_SPANS = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
_TURNS = T.ArrayType(T.StructType([T.StructField("role", T.StringType()), T.StructField("text", T.StringType())]))
_SPANS_PA = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
_TURNS_PA = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))


def gather(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Rows by turn as one record a conversation (its size is that of the output line it becomes)."""
    one = F.struct(F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("content"))
    turns = F.transform(F.sort_array(F.collect_list(one)), lambda t: F.struct(t["role"], t["content"]))
    return rows.groupBy(F.col(conv).alias(conv)).agg(F.to_json(F.struct(turns.alias("messages"))).alias("record"))


def format_records(df: DataFrame, record_col: str = "record") -> DataFrame:
    """Replaces the record by schema_hash, mapping, formatted and loss_mask; one pass, no shuffle."""
    own = ["schema_hash", "mapping", "formatted", "loss_mask"]
    kept = [c for c in df.columns if c not in (record_col, *own)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (x for whole in batches for x in slices(whole, len(kept))):
            done = [canonical(x) for x in batch.column(len(kept)).to_pylist()]
            shown = [render(t) for _, _, t in done]
            masks = [[{"start": a, "end": b} for a, b in m] for _, m in shown]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array([d[0] for d in done], pa.string()), pa.array([d[1] for d in done], pa.string()), pa.array([s for s, _ in shown], pa.string()), pa.array(masks, _SPANS_PA)], names=[*kept, *own])

    schema = T.StructType([*(df.schema[c] for c in kept), *(T.StructField(c, T.StringType()) for c in own[:3]), T.StructField(own[3], _SPANS)])
    return df.select(*kept, F.col(record_col).cast("string").alias(record_col)).mapInArrow(run, schema)


def unknown_layouts(formatted: DataFrame) -> DataFrame:
    """(schema_hash, n): records that no mapping takes, by fingerprint; invalid ones have none."""
    return formatted.where(F.col("mapping").isNull()).groupBy("schema_hash").agg(F.count("*").alias("n"))


def read_back(df: DataFrame) -> DataFrame:
    """Adds turns and loss_text, read from formatted and loss_mask alone."""
    cols = df.columns
    at, mask_at = cols.index("formatted"), cols.index("loss_mask")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (x for whole in batches for x in slices(whole, at)):
            texts, masks = batch.column(at).to_pylist(), batch.column(mask_at).to_pylist()
            turns = [[{"role": r, "text": t} for r, t in parse(x or "")] for x in texts]
            loss = ["".join(unescape(x[s["start"] : s["end"]]) for s in m or ()) if x else "" for x, m in zip(texts, masks, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(turns, _TURNS_PA), pa.array(loss, pa.string())], names=[*cols, "turns", "loss_text"])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField("turns", _TURNS), T.StructField("loss_text", T.StringType())]))


#: DuckDB SQL of the digests: what the rows say, and what the template adds to them.
ORACLE = r"""
WITH r AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')),
a AS (
  SELECT conv_id, count(*) AS n_turns,
    string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS said,
    coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '') AS loss,
    sum(13 + length(role) + length(text) + len(regexp_extract_all(text, '<\\*\|')))::BIGINT AS formatted_chars
  FROM r GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(said) AS turns_sha256, length(loss)::BIGINT AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars FROM a"""
