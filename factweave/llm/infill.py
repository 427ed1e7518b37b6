"""Fill-in-the-middle transformation: a text is cut in two places between its tokens, and its middle is
moved to the end.

Tokens are runs of ASCII letters and single other code points. They aren't listed: one Aho-Corasick
automaton scans the text for *events*, the places where the class of character changes and the control
strings. Between two changes lies either one run of letters, one token, or a gap of other characters,
as many tokens as code points. So the events' places give every token count by arithmetic, and a
token's rank is looked up among them.

The automaton reads an ASCII stand-in of as many characters as the text has code points: what isn't
ASCII is one mark, letters that no control string has are one letter, all else one blank. Its patterns are
the pairs of a letter and another character that are left, in either order, and the control strings.
"""

from __future__ import annotations

import hashlib
from functools import cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Of 100: texts that stay as they are begin here; of the others those below this have the suffix first.
PLAIN_FROM, SUFFIX_FIRST_BELOW = 90, 20
_LETTERS = {c for c in PREFIX + SUFFIX + MIDDLE if c.isalpha()}
_MARKS = {c for c in PREFIX + SUFFIX + MIDDLE if not c.isalpha()}
_STAND_IN = bytes(c if chr(c) in _LETTERS | _MARKS else 97 if chr(c).isalpha() else 32 for c in range(128)) + bytes(128)


@cache
def automaton() -> ahocorasick.Automaton:
    """Value 0: the class changes before the pattern's last character; 1: a control string ends here."""
    a = ahocorasick.Automaton()
    for x in ("a", *_LETTERS):
        for y in (" ", *_MARKS):
            a.add_word(x + y, 0)
            a.add_word(y + x, 0)
    for s in (PREFIX, SUFFIX, MIDDLE):
        a.add_word(s, 1)
    a.make_automaton()
    return a


class Units:
    """n: the text's number of tokens; controls: whether it has a control string."""

    def __init__(self, text: str):
        stand_in = text.encode("ascii", "replace").translate(_STAND_IN).decode("ascii")
        events = np.fromiter(automaton().iter(stand_in), dtype=[("at", np.int64), ("control", np.int64)])
        control = events["control"] == 1
        self.controls = bool(control.any())
        #: where each stretch of one class begins (one more: the end), and how many tokens come before it
        self.begins = np.concatenate(([0], events["at"][~control], [len(text)]))
        letters = bool(stand_in) and stand_in[0].isalpha()
        sizes = np.diff(self.begins)
        sizes[0 if letters else 1 :: 2] = 1
        self.before = np.concatenate(([0], np.cumsum(sizes)))
        self.n = int(self.before[-1])

    def offset(self, rank: int) -> int:
        """How many code points the first ``rank`` tokens have."""
        k = int(np.searchsorted(self.before, rank, side="right")) - 1
        return int(self.begins[k]) + rank - int(self.before[k]) if k + 1 < len(self.begins) else int(self.begins[-1])


def transformed(text: str, h: list[int]) -> tuple[int, str, int | None, int | None, str]:
    """n, form, prefix_chars, middle_chars and the output of a text under four integers."""
    u = Units(text)
    if not text or u.controls or h[2] % 100 >= PLAIN_FROM:
        return u.n, "plain", None, None, text
    a, b = (u.offset(r) for r in sorted((h[0] % (u.n + 1), h[1] % (u.n + 1))))
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if h[3] % 100 < SUFFIX_FIRST_BELOW:
        return u.n, "spm", a, b - a, "".join((SUFFIX, suffix, PREFIX, prefix, MIDDLE, middle))
    return u.n, "psm", a, b - a, "".join((PREFIX, prefix, SUFFIX, suffix, MIDDLE, middle))


def restored(output: str, form: str) -> str:
    """The text that an output was made of; only its control strings are looked at."""
    if form == "plain":
        return output
    first, second = (PREFIX, SUFFIX) if form == "psm" else (SUFFIX, PREFIX)
    head, _, middle = output.removeprefix(first).partition(MIDDLE)
    one, _, two = head.partition(second)
    return one + middle + two if form == "psm" else two + middle + one


def _choices(doc_id: str) -> Column:
    digest = F.sha2(F.concat(F.lit("1:"), F.coalesce(F.col(doc_id).cast("string"), F.lit(""))), 256)
    return F.transform(F.array(*[F.lit(i) for i in (1, 9, 17, 25)]), lambda i: F.conv(F.substring(digest, i, F.lit(8)), 16, 10).cast("long"))


_FIELDS = "n long, form string, prefix_chars long, middle_chars long, output string"
_OWN = pa.schema([("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64()), ("output", pa.string())])


def fill_in_middle(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: doc_id, n (tokens), form (plain, psm or spm), prefix_chars, middle_chars (null if
    plain) and output.

    The cuts and the form depend on the id alone (a null id counts as the empty text), so repeated rows and
    rows of one id are treated alike. Null text counts as empty and is plain. A text of any length is
    scanned whole; nothing is shuffled, other columns are ignored, an empty table gives no rows."""
    common.arrow_rows(docs.sparkSession, 1000)

    def run(batches):
        for b in batches:
            rows = [transformed(t, h) for t, h in zip(b["text"].to_pylist(), b["h"].to_pylist(), strict=True)]
            own = [pa.array([r[k] for r in rows], field.type) for k, field in enumerate(_OWN)]
            yield pa.RecordBatch.from_arrays([b["doc_id"], *own], ["doc_id", *_OWN.names])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), common.text_column(text).alias("text"), _choices(doc_id).alias("h")).mapInArrow(run, f"doc_id long, {_FIELDS}")


def digest(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """fill_in_middle with digests of the output and of the text that is rebuilt from it, in its place."""
    def run(batches):
        for b in batches:
            outputs, forms = b["output"].to_pylist(), b["form"].to_pylist()
            hashed = [pa.array([hashlib.sha256(x.encode("utf-8", "surrogatepass")).hexdigest() for x in xs]) for xs in (outputs, map(restored, outputs, forms))]
            yield pa.RecordBatch.from_arrays([*[b[c] for c in b.schema.names if c != "output"], *hashed], [*b.schema.names[:-1], "output_sha256", "restored_sha256"])

    return fill_in_middle(docs, doc_id, text).mapInArrow(run, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output_sha256 string, restored_sha256 string")
