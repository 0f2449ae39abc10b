"""Chat formatting by incremental black-box rendering: turn prefixes are rendered one after another, and the outputs compared."""

from __future__ import annotations

import hashlib
import os.path
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import slots, table

#: Turns of a Turnwise template's output row; it makes no difference to the output.
PART = 256
Turn = tuple[str, str]
Template = Callable[[list[Turn]], str]


class Turnwise:
    """A template that writes a header and then each turn by itself: any cut of its output between turns is the output of a cut list."""

    def __init__(self, turn: Callable[[Turn], str], header: str = "") -> None:
        self.turn, self.header = turn, header

    def __call__(self, turns: list[Turn]) -> str:
        return self.header + "".join(map(self.turn, turns))

    def after_header(self) -> Turnwise:
        return Turnwise(self.turn)


_ESCAPES = {"\\": "\\\\", "###": "\\h", "</turn>": "\\t"}
_ROLE_ESCAPES = _ESCAPES | {":": "\\c", "\n": "\\n"}
_BACK = {"\\": "\\", "h": "###", "t": "</turn>", "c": ":", "n": "\n"}


def escape(text: str, table: dict[str, str] = _ESCAPES) -> str:
    return re.sub("|".join(map(re.escape, table)), lambda m: table[m[0]], text)


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", lambda m: _BACK[m[1]], text, flags=re.S)


def _turn(turn: Turn) -> str:
    return f"### {escape(turn[0], _ROLE_ESCAPES)}:\n{escape(turn[1])}</turn>\n"


#: The template: `### role:`, the text, `</turn>`. Neither mark, nor a backslash, is left as it is inside a text.
render = Turnwise(_turn)


def parse(formatted: str) -> list[Turn]:
    """The turns of render's output, exactly."""
    out = []
    for turn in formatted.split("</turn>\n")[:-1]:
        role, _, text = turn[4:].partition(":\n")
        out.append((unescape(role), unescape(text)))
    return out


def locate(turns: list[Turn], template: Template, trained: str = "assistant") -> tuple[str, list[tuple[int, int]], bool, int]:
    """(output, spans of the trained role's texts in it, whether the template rewrites history, texts that have no span), for any template.

    Each prefix of the turns is rendered and compared with the one before: what came is the turn's span, unless what was
    there has changed. Within the span, the template's own text around the turn's is what two probes have in common; where
    that does not fit, as round a text whose length is written before it, the span is the one place where the text stands.
    """
    before, spans, rewrites, lost = template([]) if turns else "", [], False, 0
    for k, (role, text) in enumerate(turns):
        now = template(turns[: k + 1])
        if not now.startswith(before):
            rewrites = True
        elif role == trained:
            one, two = (template([*turns[:k], (role, probe)])[len(before) :] for probe in ("a", "b"))
            head = len(os.path.commonprefix([one, two]))
            tail = len(os.path.commonprefix([one[::-1], two[::-1]]))
            start, end = len(before) + head, len(now) - tail
            if start <= end and now[len(before) : start] == one[:head] and now[end:] == one[len(one) - tail :]:
                spans.append((start, end))
            elif text and now.count(text, len(before)) == 1:
                at = now.index(text, len(before))
                spans.append((at, at + len(text)))
            else:
                lost += 1
        before = now
    if rewrites:
        return before, [], True, sum(role == trained for role, _ in turns)
    return before, spans, False, lost


FORMATTED = "conv_id long, part long, turns long, formatted string, loss array<struct<start: long, end: long>>, rewrites boolean, unplaced long"


def _format(template: Template, trained: str, most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        out, here, part, turns, held = [], None, 0, [], 0
        cuts = isinstance(template, Turnwise)

        def close() -> None:
            formatted, spans, rewrites, lost = locate(turns, template.after_header() if part else template, trained)
            out.append((here[0], part, len(turns), formatted, [{"start": a, "end": b} for a, b in spans], rewrites, lost))

        def flush() -> pa.RecordBatch:
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), kind, pa.bool_(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], ["conv_id", "part", "turns", "formatted", "loss", "rewrites", "unplaced"])

        for batch in batches:
            for conv, role, text in zip(*[batch.column(c).to_pylist() for c in ("conv_id", "role", "text")]):
                if turns and ((conv,) != here or cuts and len(turns) == most):
                    close()
                    held += len(out[-1][3])
                    part, turns = (part + 1 if (conv,) == here else 0), []
                    if held > 4 << 20:
                        yield flush()
                        out, held = [], 0
                here = (conv,)
                turns.append((role or "", text or ""))
        if turns:
            close()
        if out:
            yield flush()

    return run


def format_conversations(turns: DataFrame, template: Template = render, trained: str = "assistant", most: int = PART) -> DataFrame:
    """Rows (conv_id, part, turns, formatted, loss, rewrites, unplaced), a conversation's parts in order and in one partition.

    turns: conv_id, turn, role, text; rows go by turn, then role and text; a null turn is first, a null role or text is
    empty, rows without a conv_id are one conversation, repeated rows are turns of their own. loss holds the spans of the
    trained role's texts as the template wrote them, unplaced counts those it does not hold: all, where the template
    rewrites history. Other columns stay behind; an empty table gives an empty one.

    Any template is rendered for each prefix of the whole conversation, which is one row, in memory, at a cost of the
    square of its turns. A Turnwise one gives the same output in rows of `most` turns, read in a stream.
    """
    own = turns.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", "role", "text")
    dealt = own.repartition(slots(turns.sparkSession), "conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return dealt.mapInArrow(_format(template, trained, most), FORMATTED)


DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    out, here, now = [], None, None

    def close() -> None:
        out.append((here[0], now[0], now[1].hexdigest(), now[2], now[3].hexdigest(), now[4]))

    def flush() -> pa.RecordBatch:
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    for batch in batches:
        for conv, formatted, loss in zip(*[batch.column(c).to_pylist() for c in ("conv_id", "formatted", "loss")]):
            if (conv,) != here:
                if here:
                    close()
                here, now = (conv,), [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
            for role, text in parse(formatted):
                now[0] += 1
                now[1].update(f"{role}\n{text}\n".encode())
            for span in loss:
                text = unescape(formatted[span["start"] : span["end"]])
                now[2] += len(text)
                now[3].update(text.encode())
            now[4] += len(formatted)
        if len(out) > 10_000:
            yield flush()
            out = []
    if here:
        close()
        yield flush()


def digests(formatted: DataFrame) -> DataFrame:
    """What can be read back from format_conversations' rows in their order."""
    return formatted.mapInArrow(_digest, DIGEST)


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = r"\### Assistant: </turn> ok"
    probe = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    return digests(format_conversations(turns.unionByName(probe)))


OP3_SQL = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok')),
shown AS (
  SELECT *, replace(replace(replace(text, '\', '\\'), '###', '\h'), '</turn>', '\t') AS text_out,
         replace(replace(replace(replace(replace(role, '\', '\\'), '###', '\h'), '</turn>', '\t'), ':', '\c'), chr(10), '\n') AS role_out
  FROM turns)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(length('### ' || role_out || ':' || chr(10) || text_out || '</turn>' || chr(10)))::BIGINT AS formatted_chars
FROM shown GROUP BY conv_id
"""
