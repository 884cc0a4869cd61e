"""Chat formatting: fingerprints of nested field paths select a declarative mapping to canonical turns.

A record is a JSON text. Its fingerprint is a hash of its sorted field paths with their kinds (lists count as one
element kind), so records of one layout share it whatever they say. LAYOUTS is the table of known layouts: which
fields or lists of a record become which turns; further ones can be passed. Fields that have nothing to do with any
layout's fields (ids, sources, scores) don't count when the mapping is selected. A record of an unknown layout has null
turns and layout and its fingerprint, so that nothing is lost silently. Null or broken JSON, or one nested too deep to
read: fingerprint null, turns null. Null texts and roles are empty. An empty list of turns has no turns. Rows are
formatted one by one: repeated rows repeat their results, an empty table gives an empty one, extra columns are dropped.

The template marks turns with control strings. Inside texts those are escaped by one backslash after their first
character; runs of backslashes at that place grow by one, which makes unescape() exact for every text.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, CLOSE = "<s>", "</s>"
_CONTROL = re.compile(r"(<|\[)(\\*)(s>|/s>|INST\]|/INST\]|<SYS>>|</SYS>>)")
_ESCAPED = re.compile(r"(<|\[)\\(\\*)(s>|/s>|INST\]|/INST\]|<SYS>>|</SYS>>)")


def escape(text: str) -> str:
    return _CONTROL.sub(lambda m: f"{m[1]}\\{m[2]}{m[3]}", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: m[1] + m[2] + m[3], text)


def _escape_role(role: str) -> str:
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def _unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role), flags=re.S)


def _step(key: str) -> str:
    """A key as a step of a path; one that could be read as several steps is quoted."""
    return f".{key if re.fullmatch(r'[A-Za-z0-9_-]+', key) else json.dumps(key)}"


def paths(value, at: str = "$") -> set[str]:
    """Field paths with their kinds; null and text count alike, as a missing text is still a text field."""
    if isinstance(value, dict):
        return {p for k, v in value.items() for p in paths(v, at + _step(k))} or {f"{at}:object"}
    if isinstance(value, list):
        return {p for v in value for p in paths(v, f"{at}[]")} or {f"{at}:list"}
    return {f"{at}:{'text' if value is None or isinstance(value, str) else 'number'}"}


def fingerprint_of(found: set[str]) -> str:
    return hashlib.sha256("\n".join(sorted(found)).encode("utf-8", "surrogatepass")).hexdigest()[:16]


@dataclass(frozen=True)
class Layout:
    """A layout: either `fields`, (role, fields whose texts make the turn), or `items`, a list of turns with their role and text fields.

    Fields that are empty make no turn unless they are the assistant's; several fields of a turn are set apart by an
    empty line. renamed: (role in the records, role in the turns).
    """

    name: str
    fields: tuple[tuple[str, tuple[str, ...]], ...] = ()
    items: str = ""
    role: str = ""
    text: str = ""
    renamed: tuple[tuple[str, str], ...] = ()

    def shapes(self) -> list[set[str]]:
        """The sets of field paths that records of the layout may have."""
        if self.items:
            return [{f"$.{self.items}[].{f}:text" for f in (self.role, self.text)}, {f"$.{self.items}:list"}]
        return [{f"$.{f}:text" for _, names in self.fields for f in names}]

    def turns(self, record: dict) -> list[tuple[str, str]]:
        if self.items:
            ours = dict(self.renamed)
            return [(ours.get(x.get(self.role) or "", x.get(self.role) or ""), x.get(self.text) or "") for x in record[self.items]]
        said = ((role, "\n\n".join(record[f] for f in names if record[f])) for role, names in self.fields)
        return [(role, text) for role, text in said if text or role == "assistant"]


def _answer(name: str, question: str, answer: str, *more: tuple[str, tuple[str, ...]]) -> Layout:
    return Layout(name, (*more, ("user", (question,)), ("assistant", (answer,))))


LAYOUTS = (
    _answer("completion", "prompt", "completion"),
    _answer("response", "prompt", "response"),
    _answer("question", "question", "answer"),
    _answer("instruction", "instruction", "output"),
    Layout("instruction_input", (("user", ("instruction", "input")), ("assistant", ("output",)))),
    _answer("system_response", "prompt", "response", ("system", ("system",))),
    Layout("messages", items="messages", role="role", text="content"),
    Layout("turns", items="turns", role="role", text="text"),
    Layout("conversations", items="conversations", role="from", text="value", renamed=(("human", "user"), ("gpt", "assistant"))),
)


class Selector:
    """Which layout a record has, by the fingerprint of those of its paths that touch a field of some layout."""

    def __init__(self, layouts: Sequence[Layout]):
        self.by_mark = {fingerprint_of(s): x for x in layouts for s in x.shapes()}
        self.names = {p.removesuffix(":text") for x in layouts for s in x.shapes() for p in s if p.endswith(":text")}
        self.seen: dict[str, tuple[str, Layout | None]] = {}

    def touches(self, path: str) -> bool:
        """The path is a layout's field, lies in one, or leads to one."""
        name = path.rsplit(":", 1)[0]
        return any(name == n or (name.startswith(n) and name[len(n)] in ".[") or (n.startswith(name) and n[len(name)] in ".[") for n in self.names)

    def select(self, record: dict) -> tuple[str, Layout | None]:
        """(fingerprint, layout) of a record."""
        found = paths(record)
        mark = fingerprint_of(found)
        if mark not in self.seen:
            if len(self.seen) >= 10_000:
                self.seen.clear()  # a cache: what was found is found again
            self.seen[mark] = mark, self.by_mark.get(fingerprint_of({p for p in found if self.touches(p)}))
        return self.seen[mark]


_TURN = pa.struct([("role", pa.string()), ("text", pa.string())])


def canonical_turns(df: DataFrame, key: str, record: str = "record", layouts: Sequence[Layout] = ()) -> DataFrame:
    """(key, fingerprint, layout, turns) of JSON records: the fingerprint selects the layout whose mapping makes the turns."""
    known = (*LAYOUTS, *layouts)

    def run(batches):
        selector = Selector(known)

        def one(text: str | None):
            try:
                value = json.loads(text) if text is not None else None
                if not isinstance(value, dict):
                    return None, None, None
                mark, layout = selector.select(value)
            except (ValueError, RecursionError):
                return None, None, None
            return mark, layout and layout.name, layout and [{"role": r, "text": t} for r, t in layout.turns(value)]

        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                rows = [one(t) for t in part.column(1).to_pylist()]
                cols = [pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.string(), pa.list_(_TURN)))]
                yield pa.RecordBatch.from_arrays([part.column(0), *cols], [key, "fingerprint", "layout", "turns"])

    return df.select(key, record).mapInArrow(run, f"{key} {df.schema[key].dataType.simpleString()}, fingerprint string, layout string, turns array<struct<role string, text string>>")


def format_turns(turns: list[dict]) -> tuple[str, list[tuple[int, int]]]:
    """The formatted conversation and the loss mask: code-point spans of assistant texts."""
    out, spans, at = [], [], 0
    for t in turns:
        head, body = f"{OPEN}{_escape_role(t['role'])}\n", escape(t["text"])
        if t["role"] == "assistant":
            spans.append((at + len(head), at + len(head) + len(body)))
        out.append(f"{head}{body}{CLOSE}")
        at += len(out[-1])
    return "".join(out), spans


def read_turns(formatted: str) -> Iterator[tuple[str, str]]:
    """(role, text) of each turn of a formatted conversation; ValueError where it isn't one."""
    at = 0
    while at < len(formatted):
        if not formatted.startswith(OPEN, at):
            raise ValueError(f"no turn at {at}")
        line = formatted.index("\n", at)
        end = formatted.index(CLOSE, line)
        yield _unescape_role(formatted[at + len(OPEN) : line]), unescape(formatted[line + 1 : end])
        at = end + len(CLOSE)


_SPAN = pa.struct([("start", pa.int64()), ("end", pa.int64())])


def format_chats(df: DataFrame, key: str) -> DataFrame:
    """(key, formatted, loss_spans) of the turns of canonical_turns(); null turns stay null."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                rows = [(None, None) if t is None else format_turns(t) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([f for f, _ in rows], pa.string()), pa.array([s and [{"start": a, "end": b} for a, b in s] if s is not None else None for _, s in rows], pa.list_(_SPAN))], [key, "formatted", "loss_spans"])

    return df.select(key, "turns").mapInArrow(run, f"{key} {df.schema[key].dataType.simpleString()}, formatted string, loss_spans array<struct<start bigint, end bigint>>")


DIGEST = "n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def chat_digest(df: DataFrame, key: str) -> DataFrame:
    """Read formatted conversations back: digests of their turns and of the text under the loss mask."""

    def one(formatted: str, spans: list[dict]):
        turns, n = hashlib.sha256(), 0
        for n, (role, text) in enumerate(read_turns(formatted), 1):
            turns.update(f"{role}\n{text}\n".encode())
        loss = "".join(unescape(formatted[s["start"] : s["end"]]) for s in spans)
        return n, turns.hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(formatted)

    def run(batches):
        for batch in batches:
            rows = [one(f or "", s or []) for f, s in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds))], [key, *DIGEST.replace(",", "").split()[::2]])

    return df.select(key, "formatted", "loss_spans").mapInArrow(run, f"{key} {df.schema[key].dataType.simpleString()}, {DIGEST}")


def records_of_rows(df: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(key, record): rows by turn as one JSON record a conversation, in order of turn, role and text.

    Records are as mixed as those of a corpus of many sources: each has a layout that can hold the conversation without
    loss, which its key's hash selects, and fields beside it that say where it comes from. A conversation is one
    training example, so its rows meet in one place; conversations are not compared.
    """
    item = F.struct(F.col(turn).alias("t"), F.coalesce(role, F.lit("")).alias("role"), F.coalesce(text, F.lit("")).alias("text"))
    rows = df.groupBy(F.col(key).alias(key)).agg(F.array_sort(F.collect_list(item)).alias("__turns"))
    t, pick = F.col("__turns"), F.xxhash64(key)
    roles, whole = F.transform(t, lambda x: x["role"]), F.forall(t, lambda x: x["text"] != "")
    said = lambda i: F.get(t, F.lit(i))["text"]
    made_of = lambda *names: F.coalesce((roles == F.array(*map(F.lit, names))) & whole, F.lit(False))
    listed = lambda name, r, x, ours=lambda c: c: record(F.transform(t, lambda y: F.struct(ours(y["role"]).alias(r), y["text"].alias(x))).alias(name))

    def record(*fields: Column) -> Column:
        return F.to_json(F.struct(pick.cast("string").alias("id"), F.struct(F.lit("rows").alias("kind"), F.size(t).alias("n")).alias("origin"), *fields))

    def one_of(*choices: Column) -> Column:
        at = F.pmod(pick, F.lit(len(choices)))
        out = F.when(at == 0, choices[0])
        for i, c in enumerate(choices[1:], 1):
            out = out.when(at == i, c)
        return out

    parts = F.split(said(0), "\n\n", 2)
    pairs = [record(said(0).alias(q), said(1).alias(a)) for q, a in (("prompt", "completion"), ("prompt", "response"), ("question", "answer"), ("instruction", "output"))]
    lists = [listed("messages", "role", "content"), listed("turns", "role", "text")]
    shared = listed("conversations", "from", "value", lambda c: F.when(c == "user", "human").when(c == "assistant", "gpt").otherwise(c))
    plain = ~F.arrays_overlap(roles, F.array(F.lit("human"), F.lit("gpt")))
    made = (
        F.when(made_of("user", "assistant") & (F.size(parts) == 2) & (F.get(parts, F.lit(0)) != "") & (F.get(parts, F.lit(1)) != ""), record(F.get(parts, F.lit(0)).alias("instruction"), F.get(parts, F.lit(1)).alias("input"), said(1).alias("output")))
        .when(made_of("user", "assistant"), one_of(*pairs, *lists, shared))
        .when(made_of("system", "user", "assistant"), one_of(record(said(0).alias("system"), said(1).alias("prompt"), said(2).alias("response")), *lists, shared))
        .when(plain, one_of(*lists, shared))
        .otherwise(one_of(*lists))
    )
    return rows.select(key, made.alias("record"))
