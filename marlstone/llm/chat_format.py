"""Chat formatting with spans found by incremental black-box rendering.

A template is any function from a list of (role, text) to a string. It is rendered over successive prefixes of a
conversation. If each output begins with the one before, what is new is the span of the turn that came last; if not, the
template rewrites history, which is reported. Two probe texts that differ in every character show where the text itself
begins and ends. Spans of assistant texts make the loss mask.

A long conversation is rendered in runs of ``run`` turns, each by prefixes of its own, so work doesn't grow with the square of the
turns; the runs' outputs put together must equal the template's output for all turns. Where they don't, as the template
looks at what came before, whole prefixes are rendered. If history is rewritten, offsets into earlier outputs mean nothing: spans are
then those of the texts that stand in the last output, found by probing each turn in the whole conversation, and no turn spans are given.

``marked`` is the template of the query: ``### Role: text</turn>`` and a line break a turn. It escapes control strings in
roles and texts with a backslash, and backslashes too, so that any text can be read back.

Turns are ordered by number, null first, then by role and text, which settles ties. A conversation is one output row and so
one task's work, whichever form is chosen; conversations are spread by id.

Edge cases: a null text is empty, a null role too; a null conversation id is a conversation of its own; repeated rows are turns
each; other columns are ignored; no rows give no rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Template = Callable[[list[tuple[str, str]]], str]
LEARNED = "assistant"
HEAD, TAIL = "### ", "</turn>\n"
_CONTROL = re.compile(r"\\|###|</turn>|<turn>|: ")
_TURN = re.compile(r"### ((?:[^\\:]|\\.|:(?! ))*): ((?:[^\\<]|\\.|<(?!/turn>))*)</turn>\n", re.DOTALL)


def escaped(text: str) -> str:
    return _CONTROL.sub(lambda m: "\\" + m[0], text)


def unescaped(text: str) -> str:
    return re.sub(r"\\(\\|###|</turn>|<turn>|: )", r"\1", text)


def marked(turns: list[tuple[str, str]]) -> str:
    """The turns with their markers; roles with a capital first letter if that can be undone."""
    shown = lambda r: r.capitalize() if r.isalpha() and r.isascii() and r == r.lower() else "=" + r
    return "".join(f"{HEAD}{escaped(shown(role))}: {escaped(text)}{TAIL}" for role, text in turns)


def read_back(output: str) -> list[tuple[str, str]]:
    """The turns that ``marked`` has put out."""
    turns = []
    for m in _TURN.finditer(output):
        role = unescaped(m[1])
        turns.append((role[1:] if role.startswith("=") else role.lower(), unescaped(m[2])))
    return turns


def _same(a: str, b: str) -> int:
    """Length of the common beginning, found by halving."""
    low, high = 0, min(len(a), len(b))
    while low < high:
        mid = (low + high + 1) // 2
        low, high = (mid, high) if a[:mid] == b[:mid] else (low, mid - 1)
    return low


Span = tuple[int, int, int, int]


def _text_span(template: Template, before: list[tuple[str, str]], role: str, after: list[tuple[str, str]], length: int) -> tuple[int, int] | None:
    """Where a turn's text stands in an output of this length; None if it isn't shown."""
    one, two = template([*before, (role, "0"), *after]), template([*before, (role, "1"), *after])
    if one == two:
        return None
    head = _same(one, two)
    return head, length - (len(one) - head - 1)


def _prefixes(template: Template, turns: list[tuple[str, str]]) -> tuple[str, list[Span], bool]:
    """The output, a (start, end, text start, text end) for each turn, and whether an output doesn't begin with the one before."""
    before, spans = template([]), []
    for k, (role, _) in enumerate(turns):
        now = template(turns[: k + 1])
        text = _text_span(template, turns[:k], role, [], len(now))
        if not now.startswith(before) or text is None:
            return now, [], True
        spans.append((len(before), len(now), *text))
        before = now
    return before, spans, False


def rendered(template: Template, turns: list[tuple[str, str]], run: int = 16) -> tuple[str, list[Span], bool]:
    """The output, a (start, end, text start, text end) for each turn, and whether the template rewrites history.

    Where it does, start and end are those of the text, and equal for a text that the output doesn't show.
    """
    whole = template(turns)
    parts, spans, at = [], [], 0
    for k in range(0, len(turns), run):
        output, found, rewrites = _prefixes(template, turns[k : k + run])
        if rewrites:
            break
        spans += [tuple(at + x for x in s) for s in found]
        parts.append(output)
        at += len(output)
    if len(spans) == len(turns) and "".join(parts) == whole:
        return whole, spans, False
    output, spans, rewrites = _prefixes(template, turns)
    if not rewrites and output == whole:
        return whole, spans, False
    shown = [_text_span(template, turns[:k], role, turns[k + 1 :], len(whole)) or (0, 0) for k, (role, _) in enumerate(turns)]
    return whole, [(*s, *s) for s in shown], True


def _digest(parts: Iterator[str]) -> str:
    h = hashlib.sha256()
    for p in parts:
        h.update(p.encode("utf-8", "surrogatepass"))
    return h.hexdigest()


def formatted(conversations: DataFrame, template: Template = marked) -> DataFrame:
    """(conv_id, output, turn_spans, loss_spans, rewrites_history) for each conversation; spans are [start, end) in characters."""
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    turn = F.struct(F.col("turn").alias("turn"), text("role").alias("role"), text("text").alias("text"))
    grouped = conversations.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    kind = conversations.schema["conv_id"].dataType.simpleString()
    span = "array<struct<start:long,end:long>>"

    def render(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        as_spans = lambda xs: [{"start": a, "end": b} for a, b in xs]
        for batch in batches:
            rows = []
            for conv_id, turns in zip(batch["conv_id"], batch["turns"], strict=True):
                pairs = [(t["role"], t["text"]) for t in turns]
                output, spans, rewrites = rendered(template, pairs)
                loss = [s[2:] for s, (role, _) in zip(spans, pairs, strict=True) if role == LEARNED]
                rows.append((conv_id, output, as_spans([] if rewrites else [s[:2] for s in spans]), as_spans([s for s in loss if s[0] < s[1]] if rewrites else loss), rewrites))
            yield pd.DataFrame(rows, columns=["conv_id", "output", "turn_spans", "loss_spans", "rewrites_history"])

    return grouped.mapInPandas(render, f"conv_id {kind}, output string, turn_spans {span}, loss_spans {span}, rewrites_history boolean")


def digests(outputs: DataFrame) -> DataFrame:
    """What ``formatted`` with the template ``marked`` has put out, read back, as counts and digests."""
    kind = outputs.schema["conv_id"].dataType.simpleString()

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for conv_id, output, spans in zip(batch["conv_id"], batch["output"], batch["loss_spans"], strict=True):
                turns = read_back(output)
                loss = [unescaped(output[s["start"] : s["end"]]) for s in spans]
                rows.append((conv_id, len(turns), _digest(f"{r}\n{t}\n" for r, t in turns), sum(map(len, loss)), _digest(iter(loss)), len(output)))
            yield pd.DataFrame(rows, columns=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    schema = f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    return outputs.select("conv_id", "output", "loss_spans").mapInPandas(read, schema)
