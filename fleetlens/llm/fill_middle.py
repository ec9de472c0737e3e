"""Fill-in-the-middle outputs by displacement scatter, and their inverse by gather.

A text of n units is cut at two of them into prefix, middle and suffix, which an output holds
in another order between sentinels.  A batch of texts is one array of bytes.  A scan finds the
cuts; every piece then has one displacement from its place in the texts to its place in the
outputs.  A difference array holds the change of the displacement where a piece starts, its
cumulative sum is the shift of every byte, and a numpy scatter writes all bytes at once.
``restore`` reads the sentinels of the outputs, builds the shifts of the texts' bytes the same
way and gathers.  Both go through the batch in blocks of fixed size, so that one very long text
needs no more than a few times its own bytes.

Defined results: a null text counts as empty; an empty text, one that contains a sentinel, and
one in ten of the others (by hash of the id) are ``plain``: the output is the text, and the two
lengths are null.  A null id hashes as an empty string.  Rows that share an id and a text get the
same output.  Where one piece or two are empty their sentinels stay.  Long texts are cut whole.
``restore`` gives null where an output does not have the sentinels of its form.  An empty table
gives an empty result; only the named columns are read, so other names cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from fleetlens.llm.words import buffers, trimmed

PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
FORMS = ["plain", "psm", "spm"]
PLAIN, PSM, SPM = range(3)
#: of 100 hash values, those from this one on leave a text plain, and those below the other one put the suffix first
PLAIN_FROM, SPM_BELOW = 90, 20
#: bytes moved together, and bytes of text put out together
_BLOCK, _SLICE = 1 << 18, 1 << 25
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True


def _ranks(flags: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Flags set before each place; places ascend."""
    out, total = np.zeros(len(at), np.int64), 0
    for low in range(0, len(flags), _BLOCK):
        running = np.cumsum(flags[low:low + _BLOCK], dtype=np.int64)
        i, j = np.searchsorted(at, [low, low + len(running)])
        inside = at[i:j] - low
        out[i:j] = total + np.where(inside > 0, running[inside - 1], 0)
        total += int(running[-1])
    out[at >= len(flags)] = total
    return out


def _places(flags: np.ndarray, ordinal: np.ndarray) -> np.ndarray:
    """Place of each ordinal's flag, the length where there are no more; ordinals ascend."""
    out, total = np.full(len(ordinal), len(flags), np.int64), 0
    for low in range(0, len(flags), _BLOCK):
        here = np.flatnonzero(flags[low:low + _BLOCK])
        i, j = np.searchsorted(ordinal, [total, total + len(here)])
        out[i:j] = low + here[ordinal[i:j] - total]
        total += len(here)
    return out


def _shifted(starts: np.ndarray, shift: np.ndarray, size: int) -> Iterator[tuple[int, np.ndarray]]:
    """(first place, place plus its piece's shift) of all places, a block at a time; starts ascend."""
    change = np.diff(shift, prepend=0)
    carry = 0
    for low in range(0, size, _BLOCK):
        high = min(size, low + _BLOCK)
        i, j = np.searchsorted(starts, [low, high])
        difference = np.zeros(high - low, np.int64)
        np.add.at(difference, starts[i:j] - low, change[i:j])
        difference[0] += carry
        np.cumsum(difference, out=difference)
        carry = int(difference[-1])
        yield low, difference + np.arange(low, high)


def _sentinels(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of all sentinels that lie within one text, and their texts."""
    at = np.flatnonzero(data == ord("<"))
    text = np.searchsorted(off, at, "right") - 1
    inside = at + 3 <= off[text + 1]
    at, text = at[inside], text[inside]
    kind = data[at + 1]
    real = (data[at + 2] == ord(">")) & ((kind == ord("P")) | (kind == ord("S")) | (kind == ord("M")))
    return at[real], text[real]


def scattered(data: np.ndarray, off: np.ndarray, h: np.ndarray):
    """Outputs of texts (bytes, texts + 1 offsets) by four hash values each.

    Returns units, form number, code points of prefix and of middle, output bytes, output offsets.
    """
    texts = len(off) - 1
    lead = (data & 0xC0) != 0x80
    unit = lead.copy()
    letter = _LETTER[data]
    unit[1:] &= ~(letter[1:] & letter[:-1])
    unit[off[:-1][off[:-1] < off[1:]]] = True
    before = _ranks(unit, off)
    n = np.diff(before)
    cuts = np.sort(h[:, :2] % (n + 1)[:, None], axis=1)
    a, b = (_places(unit, before[:-1] + cuts[:, k]) for k in (0, 1))
    form = np.where(h[:, 2] % 100 >= PLAIN_FROM, PLAIN, np.where(h[:, 3] % 100 < SPM_BELOW, SPM, PSM))
    form[(n == 0)] = PLAIN
    form[_sentinels(data, off)[1]] = PLAIN
    points = _ranks(lead, np.stack([off[:-1], a, b], axis=1).ravel()).reshape(-1, 3)

    start, end = off[:-1], off[1:]
    prefix, middle, suffix = a - start, b - a, end - b
    plain, spm = form == PLAIN, form == SPM
    out_off = np.concatenate([[0], np.cumsum(end - start + np.where(plain, 0, 9))])
    first = out_off[:-1] + 3  # where the first piece of an output goes
    second = first + np.where(spm, suffix, prefix) + 3
    third = second + np.where(spm, prefix, suffix) + 3
    to_prefix = np.where(plain, out_off[:-1], np.where(spm, second, first))
    to_middle = np.where(plain, to_prefix + prefix, third)
    to_suffix = np.where(plain, to_middle + middle, np.where(spm, first, second))

    out = np.empty(out_off[-1], np.uint8)
    shift = np.stack([to_prefix - start, to_middle - a, to_suffix - b], axis=1).ravel()
    for low, to in _shifted(np.stack([start, a, b], axis=1).ravel(), shift, len(data)):
        out[to] = data[low:low + len(to)]
    cut = ~plain
    for places, sentinel in ((np.where(spm, second, first), PREFIX), (np.where(spm, first, second), SUFFIX), (third, MIDDLE)):
        out[(places[cut] - 3)[:, None] + np.arange(3)] = np.frombuffer(sentinel, np.uint8)
    return n, form, points[:, 1] - points[:, 0], points[:, 2] - points[:, 1], out, out_off


def gathered(data: np.ndarray, off: np.ndarray, form: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Texts of outputs: bytes, offsets, and which outputs were well formed."""
    start, end = off[:-1], off[1:]
    at, text = _sentinels(data, off)
    cut = form != PLAIN
    at, text = at[cut[text]], text[cut[text]]
    good = ~cut | (np.bincount(text, minlength=len(start)) == 3)
    at, text = at[good[text]], text[good[text]]
    places = np.repeat(start[:, None], 3, axis=1)
    kinds = np.zeros((len(start), 3), np.uint8)
    whole = cut & good
    places[whole], kinds[whole] = at.reshape(-1, 3), data[at + 1].reshape(-1, 3)
    order = np.where((form == SPM)[:, None], np.frombuffer(b"SPM", np.uint8), np.frombuffer(b"PSM", np.uint8))
    good &= ~cut | ((kinds == order).all(axis=1) & (places[:, 0] == start))
    cut &= good

    # pieces in the order of the output, each from after its sentinel to the next one
    begin = np.where(cut[:, None], places + 3, start[:, None])
    stop = np.stack([np.where(cut, places[:, 1], start), np.where(cut, places[:, 2], start), end], axis=1)
    stop[~good] = begin[~good]
    length = stop - begin
    spm = form == SPM
    source = np.stack([np.where(spm, begin[:, 1], begin[:, 0]), begin[:, 2], np.where(spm, begin[:, 0], begin[:, 1])], axis=1)
    size = np.stack([np.where(spm, length[:, 1], length[:, 0]), length[:, 2], np.where(spm, length[:, 0], length[:, 1])], axis=1)
    ends = np.cumsum(size.ravel())
    starts = ends - size.ravel()
    back = np.empty(ends[-1] if len(ends) else 0, np.uint8)
    for low, from_ in _shifted(starts, source.ravel() - starts, len(back)):
        back[low:low + len(from_)] = data[from_]
    return back, np.concatenate([[0], ends[2::3]]).astype(np.int64), good


def _strings(data: np.ndarray, off: np.ndarray, valid: np.ndarray | None = None) -> pa.Array:
    mask = None if valid is None or valid.all() else pa.py_buffer(np.packbits(valid, bitorder="little"))
    return pa.Array.from_buffers(pa.string(), len(off) - 1, [mask, pa.py_buffer(off.astype(np.int32)), pa.py_buffer(data)])


def _slices(column: pa.Array) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
    """Rows, bytes and offsets of a column, some texts at a time."""
    data, off = buffers(column)
    i, n = 0, len(off) - 1
    while i < n:
        j = min(n, max(i + 1, int(np.searchsorted(off, off[i] + _SLICE, "right")) - 1))
        yield slice(i, j), data[off[i]:off[j]], (off[i:j + 1] - off[i]).astype(np.int64)
        i = j


def _outputs(carried: list[str]):
    names = [*carried, "n", "form", "prefix_chars", "middle_chars", "output"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h = np.stack([np.asarray(batch.column(f"h{k}")) for k in range(1, 5)], axis=1)
            for rows, data, off in _slices(batch.column("text")):
                n, form, prefix, middle, out, out_off = scattered(data, off, h[rows])
                plain = form == PLAIN
                rest = [batch.column(c).slice(rows.start, len(n)) for c in carried]
                yield pa.RecordBatch.from_arrays(
                    [*rest, pa.array(n, pa.int64()), pa.array(np.array(FORMS, object)[form], pa.string()),
                     pa.array(prefix, pa.int64(), mask=plain), pa.array(middle, pa.int64(), mask=plain), _strings(out, out_off)], names=names)

    return trimmed(run)


def _restored(carried: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.column("form").to_pylist()
            form = np.array([FORMS.index(f) if f in FORMS else PLAIN for f in names], np.int64)
            known = np.array([f in FORMS for f in names], bool) & np.asarray(batch.column("output").is_valid())
            for rows, data, off in _slices(batch.column("output")):
                back, back_off, good = gathered(data, off, form[rows])
                rest = [batch.column(c).slice(rows.start, len(good)) for c in carried]
                yield pa.RecordBatch.from_arrays([*rest, _strings(back, back_off, good & known[rows])], names=[*carried, "restored"])

    return trimmed(run)


def _types(rows: DataFrame, names: list[str]) -> str:
    return "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in rows.select(*names).schema)


def transform(docs: DataFrame, carry: dict[str, Column], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The carried columns, ``n``, ``form``, ``prefix_chars``, ``middle_chars`` and ``output`` of every text."""
    digest = F.sha2(F.concat(F.lit("1:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256)
    names = [f"carry_{c}" for c in carry]
    rows = docs.select(F.col(text_col).alias("text"), digest.alias("digest"), *(c.alias(f"carry_{n}") for n, c in carry.items()))
    rows = rows.select("text", *names, *(F.conv(F.substring("digest", 8 * k - 7, 8), 16, 10).cast("long").alias(f"h{k}") for k in range(1, 5)))
    kinds = _types(rows, names) + "n long, form string, prefix_chars long, middle_chars long, output string"
    return rows.mapInArrow(_outputs(names), kinds).toDF(*carry, "n", "form", "prefix_chars", "middle_chars", "output")


def restore(rows: DataFrame, carry: dict[str, Column], output_col: str = "output", form_col: str = "form") -> DataFrame:
    """The carried columns and ``restored``, the text that an output was made of."""
    names = [f"carry_{c}" for c in carry]
    rows = rows.select(F.col(output_col).alias("output"), F.col(form_col).alias("form"), *(c.alias(f"carry_{n}") for n, c in carry.items()))
    return rows.mapInArrow(_restored(names), _types(rows, names) + "restored string").toDF(*carry, "restored")
