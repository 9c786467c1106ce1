"""Fill-in-middle transformation by a streaming matcher that passes twice over a text and stores no units.

The first pass counts the units of a text. Two hashed numbers, taken modulo that count, are the ranks at which the text is cut;
the second pass advances one lazy iterator of matches to the lower rank and then to the higher one. Memory is that of the
text and its output, whatever the number of units. A text never leaves its task.
"""

from __future__ import annotations

import hashlib
import itertools
import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A unit: a line with its end, or what follows the last one.
LINES = r"[^\n]*\n|[^\n]+"


class Marks(NamedTuple):
    """What stands before the prefix, the suffix and the middle of an output."""

    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"

    def check(self) -> Marks:
        """No mark may be empty, or begin within another one or itself: only then is the first one found the one that was put there."""
        if len({*self}) < len(self) or "" in self:
            raise ValueError("marks must differ and hold a character")
        for a, b in itertools.product(self, self):
            if a != b and a in b or any(b.startswith(a[i:]) for i in range(1, len(a))):
                raise ValueError(f"marks {a!r} and {b!r} overlap")
        return self


def draws(key: str) -> tuple[int, int, int, int]:
    """Four numbers of 32 bits: the first four groups of eight digits of the SHA-256 of key."""
    digits = hashlib.sha256(key.encode()).hexdigest()
    return tuple(int(digits[i : i + 8], 16) for i in range(0, 32, 8))


def cuts(text: str, unit: re.Pattern, first: int, second: int) -> tuple[int, int, int]:
    """(units, end of the prefix, end of the middle): first and second modulo units + 1, the smaller one before."""
    n = sum(1 for _ in unit.finditer(text))
    low, high = sorted((first % (n + 1), second % (n + 1)))
    matches = unit.finditer(text)
    start = next(itertools.islice(matches, low - 1, low)).end() if low else 0
    end = next(itertools.islice(matches, high - low - 1, high - low)).end() if high > low else start
    return n, start, end


def transformed(text: str, key: str, unit: re.Pattern, marks: Marks, rate: int, spm_rate: int) -> tuple[int, str, int | None, int | None, str]:
    """(units, form, characters of the prefix, of the middle, output)."""
    first, second, whether, which = draws(key)
    n, start, end = cuts(text, unit, first, second)
    if not text or any(m in text for m in marks) or whether % 100 >= rate:
        return n, "plain", None, None, text
    prefix, middle, suffix = text[:start], text[start:end], text[end:]
    if which % 100 < spm_rate:
        return n, "spm", start, end - start, "".join((marks.suffix, suffix, marks.prefix, prefix, marks.middle, middle))
    return n, "psm", start, end - start, "".join((marks.prefix, prefix, marks.suffix, suffix, marks.middle, middle))


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", unit: str = LINES, marks: Marks = Marks(), rate: int = 100, spm_rate: int = 50, seed: int = 7) -> DataFrame:
    """One row per row of docs: id, n (units), form (plain, psm or spm), prefix_chars, middle_chars, output.

    `rate` in a hundred texts are cut, of those `spm_rate` in a hundred with the suffix first. Texts that are empty or hold a mark
    stay plain, and plain rows have no prefix_chars and middle_chars. A null text counts as empty; rows without an id are drawn
    as for an empty one. Units are found from left to right on code points; what no unit covers belongs to the part in which it
    stands. Texts of any length are read whole, in memory of a few times their size. Repeated rows give repeated results, an
    empty table an empty result; other columns are not read.
    """
    marks.check()
    schema = f"{id_col} {docs.schema[id_col].dataType.simpleString()}, n bigint, form string, prefix_chars bigint, middle_chars bigint, output string"
    names = [id_col, "n", "form", "prefix_chars", "middle_chars", "output"]
    types = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pattern = re.compile(unit)
        for batch in batches:
            told = [transformed(t or "", f"{seed}:{k or ''}", pattern, marks, rate, spm_rate) for t, k in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
            columns = zip(*told) if told else ((),) * 5
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(columns, types))], names=names)

    return docs.select(id_col, text_col, F.col(id_col).cast("string").alias("_key")).mapInArrow(run, schema)


def restored(output: Column | str, form: Column | str, marks: Marks = Marks()) -> Column:
    """The text that an output was made from."""
    output, form = (F.col(c) if isinstance(c, str) else c for c in (output, form))

    def between(mark: str, following: str | None) -> Column:
        start = F.instr(output, F.lit(mark)) + len(mark)
        return F.substr(output, start, F.instr(output, F.lit(following)) - start) if following else F.substr(output, start)

    psm = F.concat(between(marks.prefix, marks.suffix), between(marks.middle, None), between(marks.suffix, marks.middle))
    spm = F.concat(between(marks.prefix, marks.middle), between(marks.middle, None), between(marks.suffix, marks.prefix))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)
