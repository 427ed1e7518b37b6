"""Chat formatting by grammar round trip: render, reparse with a deterministic parser, compare with
the source, and escape what conflicts until the two are identical.

Template, one unit per turn, turns follow each other with nothing between:

    <s>[INST] body [/INST]</s>        role user
    <s>[OUT] body [/OUT]</s>          role assistant
    <s>[ROLE name] body [/ROLE]</s>   any other role (its name always escaped)

Each ``!`` after ``<s`` (``<s!>``) says that the body is escaped once: every backslash is doubled, and a
backslash follows the first character of every control string, so none is left inside. A turn is
escaped once more until the parser reads back what was written; whole conversations are read back too,
from their units joined to one stream, in which the parser itself finds where turns end.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Strings that mark turns; in a text each one makes its turn escaped.
CONTROL = ("<s>", "<s!>", "</s>", "[INST]", "[/INST]", "[OUT]", "[/OUT]", "[ROLE ", "[/ROLE]")
_CONTROL = re.compile("|".join(map(re.escape, CONTROL)))
_MARKS = {"user": ("[INST]", "[/INST]"), "assistant": ("[OUT]", "[/OUT]")}
_HEAD = re.compile(r"<s(!*)>(?:(\[INST\])|(\[OUT\])|\[ROLE ((?:[^\\\]]|\\.)*)\]) ", re.DOTALL)
_ESCAPED = re.compile(r"\\(.)", re.DOTALL)


def escape(text: str) -> str:
    return _CONTROL.sub(lambda m: f"{m[0][0]}\\{m[0][1:]}", text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    """Undo escape(): ``\\\\`` stands for a backslash, any other backslash is an inserted one."""
    return _ESCAPED.sub(lambda m: m[1], text)


def render(role: str, text: str, escapes: int) -> str:
    opening, closing = _MARKS.get(role) or (f"[ROLE {role.replace(chr(92), chr(92) * 2).replace(']', chr(92) + ']')}]", "[/ROLE]")
    for _ in range(escapes):
        text = escape(text)
    return f"<s{'!' * escapes}>{opening} {text} {closing}</s>"


class Parser:
    """Deterministic and incremental: holds what was fed since the last complete turn."""

    def __init__(self):
        self.rest = ""

    def feed(self, formatted: str) -> list[tuple[str, str, int, int]] | None:
        """(role, text, start and end of the body in what was held) of each turn that is complete now;
        None if what is held can't be one. The first closing mark ends a body."""
        held, turns, at = self.rest + formatted, [], 0
        while at < len(held):
            if not (head := _HEAD.match(held, at)):
                return None
            role, close = ("user", " [/INST]</s>") if head[2] else ("assistant", " [/OUT]</s>") if head[3] else (_ESCAPED.sub(lambda m: m[1], head[4]), " [/ROLE]</s>")
            if (end := held.find(close, head.end())) < 0:
                break
            body = held[head.end() : end]
            if _CONTROL.search(body):
                return None
            for _ in head[1]:
                body = unescape(body)
            turns.append((role, body, head.end(), end))
            at = end + len(close)
        self.rest = held[at:]
        return turns


def parse(formatted: str) -> list[tuple[str, str, int, int]] | None:
    """The turns of a whole text; None if it isn't a sequence of turns."""
    parser = Parser()
    turns = parser.feed(formatted)
    return None if turns is None or parser.rest else turns


def format_turn(role: str, text: str) -> tuple[str, tuple[str, str, int, int]]:
    """The rendered turn and what the parser reads back, identical to the source. An escaped body has
    no control string, so this ends."""
    escapes = 0
    while True:
        out = render(role, text, escapes)
        back = parse(out)
        if back is not None and len(back) == 1 and back[0][:2] == (role, text):
            return out, back[0]
        escapes += 1


_TURN = pa.schema([("conv_id", pa.int64()), ("turn", pa.int64()), ("role", pa.string()), ("text", pa.string()), ("formatted", pa.string()), ("body_start", pa.int32()), ("body_end", pa.int32())])


def _format_batches(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        done = [format_turn(r, t) for r, t in zip(b["role"].to_pylist(), b["text"].to_pylist(), strict=True)]
        yield common.batch(
            _TURN, conv_id=b["conv_id"], turn=b["turn"], role=[x[1][0] for x in done], text=[x[1][1] for x in done], formatted=[x[0] for x in done], body_start=[x[1][2] for x in done], body_end=[x[1][3] for x in done]
        )


def format_turns(conversations: DataFrame) -> DataFrame:
    """One row per turn: conv_id, turn, role and text as read back by the parser, the formatted unit,
    and the place of its body (the loss mask of an assistant turn is that body).

    A conversation's formatted text is its units in order of turn, then role, then text; each unit is
    complete in itself, so no conversation has to be held whole, whatever its length. Null text and
    null role count as empty, a null conv_id is a conversation of its own, repeated rows stay, other
    columns are ignored, and an empty table gives no rows."""
    rows = conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.coalesce("role", F.lit("")).alias("role"), common.text_column().alias("text"))
    common.arrow_rows(conversations.sparkSession)
    return rows.mapInArrow(_format_batches, "conv_id long, turn long, role string, text string, formatted string, body_start int, body_end int")


_DIGEST = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()), ("identical", pa.bool_())])


class _Reader:
    """Reads a conversation back from its stream; holds digests and at most one turn."""

    def __init__(self):
        self.parser, self.n, self.loss_chars, self.chars, self.ok = Parser(), 0, 0, 0, True
        self.turns, self.loss, self.source = hashlib.sha256(), hashlib.sha256(), hashlib.sha256()

    def feed(self, role: str, text: str, formatted: str) -> None:
        self.source.update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
        self.chars += len(formatted)
        turns = self.parser.feed(formatted)
        self.ok &= turns is not None
        for role_, text_, _, _ in turns or ():
            self.n += 1
            self.turns.update(f"{role_}\n{text_}\n".encode("utf-8", "surrogatepass"))
            if role_ == "assistant":
                self.loss_chars += len(text_)
                self.loss.update(text_.encode("utf-8", "surrogatepass"))

    def row(self, key) -> tuple:
        same = self.ok and not self.parser.rest and self.source.digest() == self.turns.digest()
        return key, self.n, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars, same


def _digest_batches(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    out: list[tuple] = []
    key, reader = None, None
    for b in batches:
        for conv, role, text, formatted in zip(*(b[c].to_pylist() for c in ("conv_id", "role", "text", "formatted")), strict=True):
            if reader is None or conv != key:
                if reader is not None:
                    out.append(reader.row(key))
                key, reader = conv, _Reader()
            reader.feed(role, text, formatted)
        if len(out) >= 1000:
            yield common.batch(_DIGEST, **dict(zip(_DIGEST.names, zip(*out, strict=True), strict=True)))
            out = []
    if reader is not None:
        out.append(reader.row(key))
    if out:
        yield common.batch(_DIGEST, **dict(zip(_DIGEST.names, zip(*out, strict=True), strict=True)))


def digest(turns: DataFrame) -> DataFrame:
    """One row per conversation, read back from its formatted units as one stream; ``identical`` says
    that this gave exactly the turns of the source (format_turns makes it true). A null conv_id is a
    conversation, turns that agree in everything stay, other columns are ignored, and an empty table
    gives no rows."""
    ordered = turns.select("conv_id", "turn", "role", "text", "formatted").repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "text", "formatted")
    return ordered.mapInArrow(_digest_batches, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, identical boolean")
