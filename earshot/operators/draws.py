"""Counted draws: draw j of iteration b is ``md5(<text>:b:j)``, its first 15 hex digits as a number, mod n.

Draws are made where they are counted. A task makes one stretch of an iteration's draws as arrays and sends
them on as one binary per chunk of the drawn positions, four bytes a draw; a chunk's draws and what lies at
its positions meet in one task. Nothing is sent a row a draw, and a task's size depends on neither n nor b.
"""

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Draws of one stretch, a multiple of ``_TAILS``; and draws that one chunk takes in all iterations.
STRETCH = 1_000_000
PER_CHUNK = 8_000_000
_TAILS = 10_000
_SINES = [int(abs(np.sin(i + 1)) * 2**32) for i in range(64)]
_TURNS = [(7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)]
# As arrays of no dimension: a call with a scalar spends more time on the scalar than on 10,000 words.
_LEFT = [[np.array(turn, dtype=np.uint32) for turn in turns] for turns in _TURNS]
_RIGHT = [[np.array(32 - turn, dtype=np.uint32) for turn in turns] for turns in _TURNS]
_START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)
_DIGITS = {
    width: [np.array([ord(c) for c in column], dtype=np.uint32) for column in zip(*(f"{j:0{width}d}" for j in range(10**width)))]
    for width in (1, 2, 3, 4)
}


def md5_numbers(text: bytes, tails: list[np.ndarray]) -> np.ndarray:
    """The first 15 hex digits of md5(text + tail) for many tails of one length, given as columns of bytes."""
    length = len(text) + len(tails)
    padded = bytearray(-(-(length + 9) // 64) * 64)
    padded[: len(text)] = text
    padded[length] = 0x80
    padded[-8:] = (8 * length).to_bytes(8, "little")
    fixed = np.frombuffer(bytes(padded), dtype="<u4").tolist()
    varying: dict[int, np.ndarray] = {}
    for at, column in enumerate(tails, start=len(text)):
        part = column << np.uint32(8 * (at % 4))
        varying[at // 4] = varying[at // 4] | part if at // 4 in varying else part
    n = len(tails[0])
    state = [np.full(n, word, dtype=np.uint32) for word in _START]
    f, g = np.empty(n, dtype=np.uint32), np.empty(n, dtype=np.uint32)
    for block in range(0, len(fixed), 16):
        a, b, c, d = (word.copy() for word in state)
        for i in range(64):
            if i < 16:
                at = i
                np.bitwise_xor(c, d, out=f)
                np.bitwise_and(f, b, out=f)
                np.bitwise_xor(f, d, out=f)
            elif i < 32:
                at = (5 * i + 1) % 16
                np.bitwise_xor(b, c, out=f)
                np.bitwise_and(f, d, out=f)
                np.bitwise_xor(f, c, out=f)
            elif i < 48:
                at = (3 * i + 5) % 16
                np.bitwise_xor(b, c, out=f)
                np.bitwise_xor(f, d, out=f)
            else:
                at = 7 * i % 16
                np.invert(d, out=f)
                np.bitwise_or(f, b, out=f)
                np.bitwise_xor(f, c, out=f)
            np.add(a, f, out=a)
            np.add(a, np.array((_SINES[i] + fixed[block + at]) & 0xFFFFFFFF, dtype=np.uint32), out=a)
            if block + at in varying:
                np.add(a, varying[block + at], out=a)
            np.left_shift(a, _LEFT[i // 16][i % 4], out=g)
            np.right_shift(a, _RIGHT[i // 16][i % 4], out=a)
            np.bitwise_or(a, g, out=a)
            np.add(a, b, out=a)
            a, b, c, d = d, a, b, c
        state = [old + new for old, new in zip(state, (a, b, c, d))]
    high, low = (word.byteswap().astype(np.uint64) for word in state[:2])
    return ((high << np.uint64(32)) | low) >> np.uint64(4)


def stretch(text: str, first: int, last: int, n: int) -> np.ndarray:
    """The positions that draws ``first`` to ``last`` (not included) take; ``text`` ends before the number of the draw."""
    out = []
    for base in range(first - first % _TAILS, last, _TAILS):
        if base:
            numbers = md5_numbers(f"{text}{base // _TAILS}".encode(), _DIGITS[4])
        else:
            # No leading zeros: numbers of one to four digits.
            taken = {w: slice(0 if w == 1 else 10 ** (w - 1), min(last, 10**w)) for w in _DIGITS}
            each = [md5_numbers(text.encode(), [c[t] for c in _DIGITS[w]]) for w, t in taken.items() if t.start < t.stop]
            numbers = np.concatenate(each)
        out.append(numbers[max(0, first - base) : last - base] % np.uint64(n))
    return np.concatenate(out).astype(np.int64)


def chunk_width(b: int) -> int:
    """Positions of one chunk."""
    return max(1024, PER_CHUNK // b)


def apart(at: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How many of the sorted draws lie in each range, and the others: two searches a range, none a draw."""
    lows, highs = np.searchsorted(at, starts), np.searchsorted(at, ends)
    others = [at[lo:hi] for lo, hi in zip([0, *highs], [*lows, len(at)])]
    return highs - lows, np.concatenate(others)


def packed_draws(tasks: DataFrame, keys: list[str], width: int, whole: tuple[np.ndarray, np.ndarray] | None = None) -> DataFrame:
    """(keys, chunk, b, times, at): the draws of each stretch, packed by chunk as offsets in it, ascending.

    ``tasks`` has the keys, ``text``, ``n``, ``b``, and the stretch ``first``. ``whole`` are the bounds
    [from, to) of a bounded number of long ranges, ascending and apart: draws in them are only counted (``times``, ``at`` is null),
    under the chunk numbers -1, -2, ... in their order.
    """
    schema = ", ".join(f.simpleString().replace(":", " ", 1) for f in tasks.select(*keys).schema.fields)
    columns = [*keys, "chunk", "b", "times", "at"]
    starts, ends = whole if whole is not None and len(whole[0]) else (None, None)

    def pack(frames):
        for pdf in frames:
            out, held = [], 0
            for row in pdf.itertuples(index=False):
                at = stretch(row.text, row.first, min(row.first + STRETCH, row.n), row.n)
                held += len(at)
                at.sort()
                found = []
                if starts is not None:
                    counts, at = apart(at, starts, ends)
                    found = [(-1 - int(i), counts[i], None) for i in np.flatnonzero(counts)]
                chunks = at // width
                cuts = np.flatnonzero(np.diff(chunks, prepend=-1))
                for lo, hi in zip(cuts, [*cuts[1:], len(at)]):
                    chunk = int(chunks[lo])
                    found.append((chunk, hi - lo, (at[lo:hi] - chunk * width).astype(np.uint32).tobytes()))
                named = [getattr(row, k) for k in keys]
                out += [(*named, chunk, row.b, times, packed) for chunk, times, packed in found]
                if held >= STRETCH:
                    yield pd.DataFrame(out, columns=columns)
                    out, held = [], 0
            if out:
                yield pd.DataFrame(out, columns=columns)

    return tasks.select(*keys, "text", "n", "b", "first").mapInPandas(
        pack, f"{schema + ', ' if schema else ''}chunk long, b long, times long, at binary"
    )


def stretches(n: Column) -> Column:
    """The first draws of the stretches of an iteration of ``n`` draws."""
    return F.explode(F.sequence(F.lit(0).cast("long"), n - 1, F.lit(STRETCH).cast("long")))


def times_drawn(pdf: pd.DataFrame, width: int):
    """(b, how often each position of the chunk was drawn) for each iteration of one chunk's packed draws."""
    for b, group in pdf.groupby("b", sort=True):
        offsets = np.frombuffer(b"".join(group["at"]), dtype=np.uint32)
        yield b, np.bincount(offsets, minlength=width)
