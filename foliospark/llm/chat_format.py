"""Chat formatting with a grammar round trip.

A turn is rendered as ``### role: text</turn>`` and a newline. A deterministic parser
reads the rendering back; where the recovered role or text differs from its source, the
conflicting content is escaped with backslashes and rendered again, until both are
identical. Turns are rendered one by one, and a turn ends where its own end mark is
found, so that a conversation is the plain concatenation of its turns.
"""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed strings of the template.
OPEN, AFTER_ROLE, CLOSE = "### ", ": ", "</turn>"
LOSS_ROLE = "assistant"

_IN_ROLE = re.compile(r"(?<!\\)(\\*)(### |</turn>|: |\Z)")
_IN_TEXT = re.compile(r"(?<!\\)(\\*)(### |</turn>|\Z)")
_BACK_ROLE = re.compile(r"(?<!\\)(\\+)(### |</turn>|: )")
_BACK_TEXT = re.compile(r"(?<!\\)(\\+)(### |</turn>)")
_MARK_IN_ROLE = re.compile(r"(?<!\\)(\\*)(### |</turn>|: )")
_MARK_IN_TEXT = re.compile(r"(?<!\\)(\\*)(### |</turn>)")


def escape(content: str, controls: re.Pattern) -> str:
    """n backslashes before a control string become 2n + 1, and at the end 2n, where a control string follows."""
    return controls.sub(lambda m: m[1] * 2 + ("\\" + m[2] if m[2] else ""), content)


def unescape(content: str, controls: re.Pattern) -> str:
    """Undoes escape: 2n + 1 backslashes before a control string become n."""
    return controls.sub(lambda m: m[1][: len(m[1]) // 2] + m[2], content)


def _until(rendered: str, at: int, marks: re.Pattern, wanted: str) -> tuple[int, int] | None:
    """(end of content, halved trailing backslashes included; end of mark) of the first mark after an even number of backslashes, if it is the wanted one."""
    while m := marks.search(rendered, at):
        if len(m[1]) % 2 == 0:
            return (m.start() + len(m[1]) // 2, m.end()) if m[2] == wanted else None
        at = m.end()
    return None


def parse_turn(rendered: str, at: int = 0) -> tuple[str, str, tuple[int, int], int] | None:
    """(role, text, span of the rendered text, end) of the turn at a place, or None where the grammar does not hold."""
    if not rendered.startswith(OPEN, at):
        return None
    if not (role := _until(rendered, at + len(OPEN), _MARK_IN_ROLE, AFTER_ROLE)):
        return None
    if not (text := _until(rendered, role[1], _MARK_IN_TEXT, CLOSE)) or not rendered.startswith("\n", text[1]):
        return None
    span = (role[1], text[1] - len(CLOSE))
    return unescape(rendered[at + len(OPEN) : role[0]], _BACK_ROLE), unescape(rendered[role[1] : text[0]], _BACK_TEXT), span, text[1] + 1


def parse(rendered: str) -> list[tuple[str, str]]:
    """All turns of a rendered conversation."""
    out, at = [], 0
    while at < len(rendered):
        if not (turn := parse_turn(rendered, at)):
            raise ValueError(f"no turn at {at}")
        out.append(turn[:2])
        at = turn[3]
    return out


def render_turn(role: str, text: str) -> tuple[str, int, int]:
    """(rendering, loss start, loss end); the span is empty but for the assistant's texts."""
    own_role, own_text = role, text
    for _ in range(3):
        rendered = f"{OPEN}{own_role}{AFTER_ROLE}{own_text}{CLOSE}\n"
        turn = parse_turn(rendered)
        if turn and turn[:2] == (role, text) and turn[3] == len(rendered):
            return (rendered, *turn[2]) if role == LOSS_ROLE else (rendered, 0, 0)
        if turn is None or turn[0] != role:
            own_role = escape(role, _IN_ROLE)
        own_text = escape(text, _IN_TEXT)
    raise ValueError("a turn does not come back from its rendering")


def format_turns(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, formatted, loss_start, loss_end) for rows with conv_id, turn, role and text.

    In order of turn, the formatted strings of a conversation make up its rendering. Null
    roles and texts count as empty; other columns are dropped. Repeated rows stay."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            made = [render_turn(r or "", t or "") for r, t in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
            columns = list(zip(*made)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(columns[0], pa.string()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.int64())], names=["conv_id", "turn", "formatted", "loss_start", "loss_end"])

    kinds = dict(turns.dtypes)
    return turns.select("conv_id", "turn", "role", "text").mapInArrow(run, f"conv_id {kinds['conv_id']}, turn {kinds['turn']}, formatted string, loss_start long, loss_end long")


def read_back(formatted: DataFrame) -> DataFrame:
    """A row of counts and digests for each conversation, parsed from its formatted turns.

    Turns of equal number, null first, are ordered by their rendering. A conversation is
    streamed through its task turn by turn and never gathered; a null conv_id is one
    conversation of its own. An empty table gives an empty table."""

    def run(batches):
        import pyarrow as pa

        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        open_id, state = None, None

        def close():
            return [open_id, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4]]

        kind = None
        for batch in batches:
            kind, done = batch.schema.field(0).type, []
            for conv, rendered, start, end in zip(*(batch.column(n).to_pylist() for n in ("conv_id", "formatted", "loss_start", "loss_end"))):
                if state is None or conv != open_id:
                    if state is not None:
                        done.append(close())
                    open_id, state = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, text in parse(rendered):
                    state[0] += 1
                    state[1].update(f"{role}\n{text}\n".encode())
                state[4] += len(rendered)
                if end > start:
                    masked = parse_turn(f"{OPEN}{AFTER_ROLE}{rendered[start:end]}{CLOSE}\n")[1]
                    state[2] += len(masked)
                    state[3].update(masked.encode())
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*done), (kind, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()))], names=names)
        if state is not None:
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(close(), (kind, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()))], names=names)

    ordered = formatted.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "formatted")
    return ordered.mapInArrow(run, f"conv_id {dict(formatted.dtypes)['conv_id']}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


#: A conversation whose texts look like the template, escapes included.
PLANTED = r"\### Assistant: </turn> ok"


def query(spark, sf_dir: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    role = F.when(F.col("id") == 0, "user").otherwise("assistant")
    planted = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), role.alias("role"), F.lit(PLANTED).alias("text"))
    return read_back(format_turns(turns.unionByName(planted)))


SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), e AS (
  SELECT *, regexp_replace(regexp_replace(text, '(\\*)(### |</turn>)', '\1\1\\\2', 'g'), '(\\+)$', '\1\1') AS escaped,
         regexp_replace(regexp_replace(role, '(\\*)(### |</turn>|: )', '\1\1\\\2', 'g'), '(\\+)$', '\1\1') AS named FROM t
), f AS (
  SELECT *, '### ' || named || ': ' || escaped || '</turn>' || chr(10) AS formatted FROM e
)
SELECT conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, formatted)) AS turns_sha256,
       sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn NULLS FIRST, formatted), '')) AS loss_sha256,
       sum(length(formatted))::BIGINT AS formatted_chars
FROM f GROUP BY conv_id
"""
