r"""Chat formatting of typed content parts (operator 2).

A turn is written as ``<turn role>``, a newline, its content, ``</turn>`` and a
newline. Every control string begins with an unescaped ``<``. In texts and roles
``\``, ``<`` and ``>`` are preceded by a backslash, so any text can be read
back. A visitor flattens the content parts of a turn in order: texts are escaped,
and each image, audio or document part becomes a numbered placeholder such as
``<image 0>``, with its reference and the number of model tokens it expands to.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from staylens.llm.common import text_or_empty

PART = "struct<kind:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>"
OUTPUT = (
    "role string, formatted string, loss array<struct<start:long,length:long>>, "
    "attachments array<struct<number:int,kind:string,ref:string,start:long,n_tokens:long>>, media_tokens long"
)
SPECIAL = re.compile(r"[\\<>]")
CONTROL = re.compile(r"\\(.)|<turn |>\n|</turn>\n|<(image|audio|document) (\d+)>", re.DOTALL)


def escape(text: str) -> str:
    return SPECIAL.sub(r"\\\g<0>", text)


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.DOTALL)


class Flattener:
    """Visits the parts of one turn in order; one method per kind."""

    def __init__(self, role: str, learn: bool, patch: int, audio_rate: float, page_tokens: int):
        self.learn, self.patch, self.audio_rate, self.page_tokens = learn, patch, audio_rate, page_tokens
        self.out = [f"<turn {escape(role)}>\n"]
        self.at = len(self.out[0])
        self.loss: list[dict] = []
        self.attachments: list[dict] = []

    def write(self, text: str) -> None:
        self.out.append(text)
        self.at += len(text)

    def visit(self, part: dict) -> None:
        kind = part.get("kind") or "text"
        getattr(self, f"visit_{kind}", self.visit_unknown)(part)

    def visit_text(self, part: dict) -> None:
        text = escape(part.get("text") or "")
        if self.learn and text:
            self.loss.append({"start": self.at, "length": len(text)})
        self.write(text)

    def visit_image(self, part: dict) -> None:
        """One token for each patch of the image."""
        wide, high = (-(-(part.get(side) or 0) // self.patch) for side in ("width", "height"))
        self.attach("image", part, wide * high)

    def visit_audio(self, part: dict) -> None:
        self.attach("audio", part, -int(-(part.get("seconds") or 0.0) * self.audio_rate // 1))

    def visit_document(self, part: dict) -> None:
        self.attach("document", part, (part.get("pages") or 0) * self.page_tokens)

    def visit_unknown(self, part: dict) -> None:
        raise ValueError(f"unknown kind of content part: {part['kind']!r}")

    def attach(self, kind: str, part: dict, tokens: int) -> None:
        number = len(self.attachments)
        self.attachments.append(
            {"number": number, "kind": kind, "ref": part.get("ref"), "start": self.at, "n_tokens": tokens}
        )
        self.write(f"<{kind} {number}>")

    def close(self) -> str:
        self.write("</turn>\n")
        return "".join(self.out)


def text_parts(df: DataFrame, text_col: str = "text", parts_col: str = "parts") -> DataFrame:
    """Turns with plain texts as turns with one text part each."""
    part = F.struct(F.lit("text").alias("kind"), text_or_empty(text_col).alias("text"))
    fields = [f.split(":") for f in PART[7:-1].split(",")][2:]
    empty = F.struct(part["kind"].alias("kind"), part["text"].alias("text"),
                     *[F.lit(None).cast(kind).alias(name) for name, kind in fields])
    return df.withColumn(parts_col, F.array(empty))


def format_turns(
    df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
    parts_col: str = "parts", learned_roles: tuple[str, ...] = ("assistant",),
    patch: int = 16, audio_rate: float = 25.0, page_tokens: int = 512,
) -> DataFrame:
    """One row per turn: conv_id, turn, role, formatted text, loss spans, attachments, media_tokens.

    The formatted conversation is the turns' texts in order of turn. Loss spans
    (in code points of the turn's formatted text) cover the escaped texts of
    learned roles, no control string. A null role, text or list of parts counts
    as empty, a null part is left out; an unknown kind of part is an error.
    Repeated rows stay repeated, an empty table gives no rows, other columns
    are ignored. No shuffle.
    """
    kinds = {c: df.schema[c].dataType.simpleString() for c in (conv_col, turn_col)}

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in frames:
            rows: dict[str, list] = {
                c: [] for c in ("role", "formatted", "loss", "attachments", "media_tokens")}
            for role, parts in zip(frame.column(2).to_pylist(), frame.column(3).to_pylist(), strict=True):
                turn = Flattener(role, role in learned_roles, patch, audio_rate, page_tokens)
                for part in parts or []:
                    if part is not None:
                        turn.visit(part)
                rows["role"].append(role)
                rows["formatted"].append(turn.close())
                rows["loss"].append(turn.loss)
                rows["attachments"].append(turn.attachments)
                rows["media_tokens"].append(sum(a["n_tokens"] for a in turn.attachments))
            span = pa.struct([("start", pa.int64()), ("length", pa.int64())])
            file = pa.struct([("number", pa.int32()), ("kind", pa.string()), ("ref", pa.string()),
                              ("start", pa.int64()), ("n_tokens", pa.int64())])
            yield pa.RecordBatch.from_arrays(
                [
                    frame.column(0), frame.column(1), pa.array(rows["role"], pa.string()),
                    pa.array(rows["formatted"], pa.string()), pa.array(rows["loss"], pa.list_(span)),
                    pa.array(rows["attachments"], pa.list_(file)), pa.array(rows["media_tokens"], pa.int64()),
                ],
                names=["conv", "turn", *rows],
            )

    picked = df.select(
        F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"),
        F.coalesce(F.col(role_col).cast("string"), F.lit("")).alias("role"), F.col(parts_col).alias("parts"),
    )
    schema = f"conv {kinds[conv_col]}, turn {kinds[turn_col]}, {OUTPUT}"
    return picked.mapInArrow(run, schema).withColumnsRenamed({"conv": conv_col, "turn": turn_col})


def parse(formatted: str) -> list[tuple[str, list[tuple[str, str]]]]:
    """Turns read back from a formatted text: (role, [(kind, text or number)])."""
    turns: list[tuple[str, list[tuple[str, str]]]] = []
    role, content, since, in_role = "", [], 0, False
    for m in CONTROL.finditer(formatted):
        if m[1] is not None:
            continue
        text = unescape(formatted[since: m.start()])
        if m[0] == "<turn ":
            in_role = True
        elif m[0] == ">\n" and in_role:
            role, content, in_role = text, [], False
        else:
            if text:
                content.append(("text", text))
            if m[2]:
                content.append((m[2], m[3]))
            else:
                turns.append((role, content))
        since = m.end()
    return turns


def digest(formatted: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn") -> DataFrame:
    """Per conversation what its formatted turns say when read back.

    Turns of a conversation meet sorted in one task and are hashed as they
    stream by; only hash states are held, however long a conversation is. Turns
    with equal numbers are ordered by role and text.
    """
    kind = formatted.schema[conv_col].dataType.simpleString()

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state, done = None, None, []

        def close() -> None:
            if state:
                done.append((key, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4]))

        for frame in frames:
            for row in frame.to_pylist():
                if state is None or row["conv"] != key:
                    close()
                    key, state = row["conv"], [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                (role, content), = parse(row["formatted"])
                text = "".join(t for k, t in content if k == "text")
                state[0] += 1
                state[1].update(f"{role}\n{text}\n".encode())
                for span in row["loss"]:
                    learned = unescape(row["formatted"][span["start"]: span["start"] + span["length"]])
                    state[2] += len(learned)
                    state[3].update(learned.encode())
                state[4] += len(row["formatted"])
            if done:
                yield pack(done)
                done = []
        close()
        if done:
            yield pack(done)

    def pack(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [to, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        columns = zip(*rows, strict=True)
        return pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)],
            names=["conv", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"],
        )

    from pyspark.sql.pandas.types import to_arrow_type

    to = to_arrow_type(formatted.schema[conv_col].dataType)
    rows = (
        formatted.select(F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"), "formatted", "loss")
        .repartition("conv").sortWithinPartitions("conv", "turn", "formatted")
    )
    schema = (f"conv {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, "
              "formatted_chars long")
    return rows.mapInArrow(run, schema).withColumnRenamed("conv", conv_col)
