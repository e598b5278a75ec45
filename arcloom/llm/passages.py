"""Fuzzy passages that documents share, by chaining seed matches.

Distinct texts are cut into words. Of every ``window`` consecutive runs of ``seed``
words the one with the lowest hash is a seed, so texts that share
``seed + window - 1`` words in a row share one. Each seed is a key, and so is each run
of as many consecutive seeds, with their distances, as ``min_words`` shared words are
sure to hold: texts that agree for longer meet under the run's key, however many
others hold its seeds one by one. Monotonous passages are keys as a whole. The texts of a key that few
hold are all matched with each other, those of others with its lowest and its highest, the i-th
place in a text with the i-th (and in turn for the rest): what many documents share leads to links
in proportion to its places, never to all pairs. No shared passage is lost by that: any ``min_words`` words begin with one run of
seeds, found from these words alone, and of the texts that hold a run those with the same
words around it are a class, whose places are all matched with those of its lowest text.
So two texts that share ``min_words`` words in a row are linked with each other or both
with a third text on these very words. The matches of two documents are
chained in order in both, with costs for gaps, through Fenwick trees of maxima; each
chain's stretches of words are then aligned, and what is long and alike enough is a
passage. Copies of whole texts are linked to their text's first document.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from arcloom.llm import components
from arcloom.llm.common import n_words, texts
from arcloom.llm.neardup import shingle_hashes
from arcloom.llm.wordhash import word_hashes
from arcloom.operators.sizing import is_small, sized

SEED = 5
WINDOW = 10
MIN_WORDS = 50
UNLIKE = 3  # a stretch that pays for its other words has more than three quarters of equal ones
SEVERAL = 8  # texts of a key that are all matched with each other
AT_ONCE = 50_000  # words of texts that are cut together
QUERIES = 4_000  # matches that look through the cells before them together
NOTHING = (-float("inf"), -1)
NEVER = np.iinfo(np.int64).max
MATCHES = "a bigint, b bigint, a_from int, a_to int, b_from int, b_to int, x array<int>, y array<int>"
FOUND = "a bigint, b bigint, a_from int, a_to int, b_from int, b_to int, n_same int, likeness double"


# Frees the disk of a query's shuffles as it ends, not when the driver happens to collect garbage.
CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(df: DataFrame, purpose: str) -> DataFrame:
    """``components.stored``, its shuffles gone afterwards: some hold more than the input."""
    conf = df.sparkSession.conf
    before = conf.get(CLEAN_UP, "false")
    conf.set(CLEAN_UP, "true")
    try:
        return components.stored(df, purpose)
    finally:
        conf.set(CLEAN_UP, before)


def seeds(
    word_hashes: np.ndarray, ends: np.ndarray, size: int = SEED, window: int = WINDOW
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes and places (in all words) of the lowest runs of each window, where the first window starts
    that has it, and in how many it is.

    The words are those of many texts, each of ``size + window - 1`` at least, that of a
    word ends before ``ends``.
    """
    h = shingle_hashes(word_hashes, size)
    views = np.lib.stride_tricks.sliding_window_view(h, window)
    starts = np.flatnonzero(np.arange(len(views)) + window + size - 1 <= ends[: len(views)])
    # The rightmost of equals, so that a repeated run moves on with the window.
    at = starts + window - 1 - views[starts][:, ::-1].argmin(axis=1)
    new = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
    return h[at[new]], at[new], starts[new], np.diff(np.append(new, len(at)))


def run_length(size: int, window: int, least: int) -> int:
    """How many consecutive seeds any ``least`` words hold, of those that 63 bits can tell the distances of."""
    sure = -(-(least - size - window + 2) // window)
    return max(1, min(sure, 63 // window.bit_length() + 1))


def monotonous(word_hashes: np.ndarray, text: np.ndarray, ends: np.ndarray, least: int) -> np.ndarray:
    """Where ``least`` words of one text start of which fewer than half are distinct."""
    n = len(word_hashes)
    order = np.lexsort((word_hashes, text))
    before = np.full(n, -1)
    x, y = order[:-1], order[1:]
    again = (word_hashes[x] == word_hashes[y]) & (text[x] == text[y])
    before[y[again]] = x[again]
    # No window repeats more words than stand in it and have stood less than its length before.
    near = np.cumsum(np.append(0, (before >= 0) & (np.arange(n) - before < least)))
    starts = np.flatnonzero(((near[least:] - near[:-least]) * 2 > least) & (np.arange(n - least + 1) + least <= ends[: n - least + 1]))
    # A word is new in a window if it stood last before the window's start.
    views = np.lib.stride_tricks.sliding_window_view(before, least)[starts]
    return starts[(views < starts[:, None]).sum(1) * 2 < least]


def keys(
    texts: list[np.ndarray], size: int, window: int, run: int, least: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``(text, key, place, nth, times, gaps, starts)`` of the seeds, of the runs of ``run`` seeds and of monotonous passages.

    ``texts`` are word hashes of at least ``least`` words each. ``gaps`` packs a run's distances
    from seed to seed, the first in the lowest bits; 0 is a single seed. Where words
    repeat, equal runs of seeds stand in unequal surroundings, so each monotonous passage of
    ``least`` words is a key; its ``gaps`` is -1. A key stands at ``times`` places of its
    text, this one is number ``nth``. ``starts`` tells which passages of ``least`` words, but for
    monotonous ones, have this run as their first: its lowest byte how many words before the
    place the first may start, the bits above it which of the places from there on do.
    """
    lengths = np.array([len(t) for t in texts])
    words_ = np.concatenate(texts)
    text = np.repeat(np.arange(len(texts)), lengths)
    start = np.cumsum(lengths) - lengths
    ends = np.repeat(start + lengths, lengths)
    h, at, since, held = seeds(words_, ends, size, window)
    dull = monotonous(words_, text, ends, least)
    begins = np.arange(len(words_)) + least <= ends
    begins[dull] = False
    # The words of a passage alone tell its seeds, so equal ones have the same first run.
    starts = at - since
    for n in range(window):
        starts |= ((n < held) & begins[np.minimum(since + n, len(begins) - 1)]).astype(np.int64) << (8 + n)
    gaps = np.zeros(len(h), np.int64)
    n = len(h) - run + 1
    if run > 1 and n > 0:
        step, bits = np.diff(at).astype(np.int64), window.bit_length()
        one = text[at[:n]] == text[at[run - 1 :]]
        packed = np.zeros(n, np.int64)
        for j in range(run - 1):
            packed |= np.where(one, step[j : j + n], 0) << (bits * j)
        made = shingle_hashes(h.view(np.int64), run)
        made = shingle_hashes(np.stack([made, packed.view(np.uint64)], 1).reshape(-1).view(np.int64), 2)[::2]
        starts = np.concatenate([np.zeros(len(h), np.int64), starts[:n][one]])
        h, at, gaps = np.concatenate([h, made[one]]), np.concatenate([at, at[:n][one]]), np.concatenate([gaps, packed[one]])
    if len(dull):
        h = np.concatenate([h, shingle_hashes(words_, least, dull)])
        at, gaps = np.concatenate([at, dull]), np.concatenate([gaps, np.full(len(dull), -1)])
        starts = np.concatenate([starts, np.zeros(len(dull), np.int64)])
    of = text[at]
    order = np.lexsort((h, of))
    fresh = np.ones(len(h), bool)
    fresh[1:] = (h[order][1:] != h[order][:-1]) | (of[order][1:] != of[order][:-1])
    first = np.flatnonzero(fresh)
    held = np.diff(np.append(first, len(h)))
    nth, times = np.empty(len(h), np.int32), np.empty(len(h), np.int32)
    nth[order] = np.arange(len(h)) - np.repeat(first, held)
    times[order] = np.repeat(held, held)
    return of, h, (at - start[of]).astype(np.int32), nth, times, gaps, starts


def unpacked(
    i: np.ndarray, j: np.ndarray, gaps: np.ndarray, size: int, window: int, least: int
) -> tuple[np.ndarray, np.ndarray]:
    """The distinct matches of ``size`` words in matches of keys; a passage has one at least every ``window`` words."""
    bits, parts = window.bit_length(), []
    whole = gaps < 0
    for off in [*range(0, least - size, window), least - size]:
        parts.append((i[whole] + off, j[whole] + off))
    i, j, gaps = i[~whole], j[~whole], gaps[~whole]
    while len(i):
        parts.append((i, j))
        more = gaps > 0
        i, j, gaps = i[more], j[more], gaps[more]
        step = gaps & ((1 << bits) - 1)
        i, j, gaps = i + step, j + step, gaps >> bits
    both = np.unique((np.concatenate([x[0] for x in parts]).astype(np.int64) << 32) | np.concatenate([x[1] for x in parts]))
    return both >> 32, both & 0xFFFFFFFF


def unpacked_of(
    pair: np.ndarray, i: np.ndarray, j: np.ndarray, gaps: np.ndarray, size: int, window: int, least: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``unpacked`` for the matches of many pairs, in order of ``(pair, i, j)``, and for stretches of
    equal words, whose ``gaps`` is -2 for ``least`` words and lower by one for each word more."""
    bits, parts = window.bit_length(), []
    long = gaps < -1
    if long.any():
        parts.append(stretches(pair[long], i[long], j[long], least - 2 - gaps[long], size, window))
        pair, i, j, gaps = pair[~long], i[~long], j[~long], gaps[~long]
    whole = gaps < 0
    if whole.any():
        for off in [*range(0, least - size, window), least - size]:
            parts.append((pair[whole], i[whole] + off, j[whole] + off))
        pair, i, j, gaps = pair[~whole], i[~whole], j[~whole], gaps[~whole]
    while len(i):
        parts.append((pair, i, j))
        more = gaps > 0
        pair, i, j, gaps = pair[more], i[more], j[more], gaps[more]
        step = gaps & ((1 << bits) - 1)
        i, j, gaps = i + step, j + step, gaps >> bits
    pair, i, j = (np.concatenate([x[k] for x in parts]).astype(np.int64) for k in range(3)) if parts else (np.zeros(0, np.int64),) * 3
    wide = [int(x.max(initial=0)).bit_length() for x in (pair, i, j)]
    if sum(wide) < 64:
        # One number each, which sorts faster than three.
        packed = np.sort((((pair << wide[1]) | i) << wide[2]) | j)
        packed = packed[np.append(True, packed[1:] != packed[:-1])] if len(packed) else packed
        return packed >> (wide[1] + wide[2]), (packed >> wide[2]) & ((1 << wide[1]) - 1), packed & ((1 << wide[2]) - 1)
    order = np.lexsort((j, i, pair))
    pair, i, j = pair[order], i[order], j[order]
    fresh = np.ones(len(i), bool)
    fresh[1:] = (pair[1:] != pair[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])
    return pair[fresh], i[fresh], j[fresh]


def stretches(
    pair: np.ndarray, i: np.ndarray, j: np.ndarray, length: np.ndarray, size: int, window: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Matches of ``size`` words every ``window`` words, and at the end, of stretches of equal words, which are joined where they meet."""
    order = np.lexsort((i, i - j, pair))
    pair, i, off, end = pair[order], i[order].astype(np.int64), (i - j)[order], (i + length)[order]
    fresh = np.append(True, (pair[1:] != pair[:-1]) | (off[1:] != off[:-1]))
    shift = np.cumsum(fresh) << 40
    end = np.maximum.accumulate(end + shift) - shift
    first = np.flatnonzero(fresh | np.append(True, i[1:] > end[:-1]))
    start, last = i[first], end[np.append(first[1:], len(i)) - 1] - size
    n = -(-(last - start) // window) + 1
    row = np.repeat(np.arange(len(n)), n)
    at = np.minimum(start[row] + window * (np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)), last[row])
    return pair[first][row], at, at - off[first][row]


def rising(pair: np.ndarray, i: np.ndarray, j: np.ndarray, size: int, gap: float, reach: int) -> tuple[np.ndarray, np.ndarray]:
    """Where matches in order of ``(pair, i, j)`` fall apart, and whether each part is one chain as it stands.

    No step reaches beyond ``reach`` words of ``i``, so the parts have no chains in common.
    In a part that rises in both throughout, by steps that cost less than the ``size`` they
    earn, each match's best step is from the one before.
    """
    if not len(i):
        return np.zeros(0, np.int64), np.zeros(0, bool)
    x, y = np.diff(i), np.diff(j)
    cut = (pair[1:] != pair[:-1]) | (x > reach)
    starts = np.append(0, np.flatnonzero(cut) + 1)
    bad = ~cut & ((x <= 0) | (y <= 0) | (y > reach) | (gap * (x + y) > size - gap / 2))
    return starts, np.add.reduceat(np.append(0, bad), starts) == 0


def diagonals(part: np.ndarray, a: np.ndarray, b: np.ndarray, window: int) -> list[np.ndarray]:
    """Cut the matches of each part into those that keep their distance, with steps of at most ``window``."""
    order = np.lexsort((a, a - b, part))
    x, d, p = a[order], (a - b)[order], part[order]
    return np.split(order, np.flatnonzero((p[1:] != p[:-1]) | (d[1:] != d[:-1]) | (x[1:] - x[:-1] > window)) + 1)


class Fenwick:
    """Maxima over the first places, with the index that reached each."""

    def __init__(self, size: int):
        self.best = [NOTHING] * (size + 1)

    def put(self, at: int, value: float, index: int) -> None:
        best, node = self.best, at + 1
        # A node that already holds more lies below nodes that do too.
        while node < len(best) and best[node][0] < value:
            best[node] = (value, index)
            node += node & -node

    def below(self, end: int) -> tuple[float, int]:
        """The best over places 0 to ``end - 1``."""
        found = NOTHING
        while end:
            if self.best[end][0] > found[0]:
                found = self.best[end]
            end -= end & -end
        return found


class Behind:
    """Maxima over the ``reach`` places before a place.

    Places are cut into blocks of ``reach``: those before a place are the first of its
    block and the last of the block before, a prefix of a Fenwick tree each.
    """

    def __init__(self, reach: int):
        self.reach = reach
        self.blocks: dict[int, tuple[Fenwick, Fenwick]] = {}

    def put(self, at: int, value: float, index: int) -> None:
        block, place = divmod(at, self.reach)
        if block not in self.blocks:
            self.blocks[block] = Fenwick(self.reach), Fenwick(self.reach)
        first, last = self.blocks[block]
        first.put(place, value, index)
        last.put(self.reach - 1 - place, value, index)

    def best(self, at: int) -> tuple[float, int]:
        """The best over places ``at - reach`` to ``at - 1``."""
        block, place = divmod(at, self.reach)
        found = self.blocks[block][0].below(place) if block in self.blocks else NOTHING
        if block - 1 in self.blocks:
            found = max(found, self.blocks[block - 1][1].below(self.reach - place))
        return found


def chains(a: np.ndarray, b: np.ndarray, size: int, gap: float, reach: int) -> list[list[int]]:
    """Cut matches ``(a[i], b[i])`` into chains that rise in both.

    A chain earns ``size`` per match and pays ``gap`` for each word skipped on either
    side: value ``size + gap * (a + b)`` raised by position turns the cost into a
    maximum over a range of ``b``. A step has at most ``reach`` words on either side.
    ``a`` is walked in blocks of ``reach``: the scores of the block before are final, so
    its matches enter from the last on, each before the first that it may not reach is
    asked, and those of the block itself enter as it is walked. Nothing is ever taken
    out, which Fenwick trees of maxima could not do. Chains are taken by end score,
    each match serving once.
    """
    order = np.lexsort((-b, a))
    x, y = a.tolist(), b.tolist()
    block_of = a[order] // reach
    score, back = [float(size)] * len(x), [-1] * len(x)
    before: list[int] = []
    last = None
    for part in np.split(order, np.flatnonzero(np.diff(block_of)) + 1) if len(order) else []:
        block = part.tolist()
        number = x[block[0]] // reach
        waiting = before if last == number - 1 else []
        older, carried = Behind(reach), []
        for i in reversed(block):
            while waiting and x[waiting[-1]] >= x[i] - reach:
                j = waiting.pop()
                older.put(y[j], score[j] + gap * (x[j] + y[j]), j)
            carried.append(older.best(y[i]))
        here = Behind(reach)
        for i, found in zip(block, reversed(carried)):
            raised, j = max(found, here.best(y[i]))
            total = raised - gap * (x[i] + y[i]) + size
            if j >= 0 and total > size:
                score[i], back[i] = total, j
            here.put(y[i], score[i] + gap * (x[i] + y[i]), i)
        before, last = block, number
    return taken(np.asarray(score), back)


def asked_first(reach: int) -> np.ndarray:
    """Of places 0 to ``reach - 1`` in a block and the ``reach`` places before each: when ``Behind`` asks for them.

    Those of the block before, whose trees count from its end, are from ``reach`` on.
    """
    walk = np.zeros((reach + 1, reach), np.int64)
    for end in range(1, reach + 1):
        left, n = end, 0
        while left:
            walk[end, left - (left & -left) : left] = n
            left, n = left - (left & -left), n + 1
    out = np.zeros((reach, reach), np.int64)
    for place in range(reach):
        out[place, reach - place :] = walk[place, :place]
        out[place, : reach - place] = reach + walk[reach - place, : reach - place][::-1]
    return out


def scores(part: np.ndarray, a: np.ndarray, b: np.ndarray, size: int, gap: float, reach: int) -> tuple[np.ndarray, np.ndarray]:
    """The best score of a chain up to each match, and the match before it or -1, as in ``chains``, for many parts at once.

    Matches stand in order of ``(part, a, b)``. All parts are walked together, place by place of
    ``a``, in the blocks of ``chains``; in place of trees each place of ``b`` has a cell of one
    array, and the ``reach`` cells before a match are looked through at once. Of equal scores
    the trees' choice is taken, so that it does not matter which way a part goes.
    """
    first = np.flatnonzero(np.append(True, part[1:] != part[:-1]))
    of_part = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(a))))
    low, high = np.minimum.reduceat(b, first), np.maximum.reduceat(b, first)
    room = high - low + 1 + reach
    cell = (np.cumsum(room) - room - low)[of_part] + b  # where the window before it begins
    level = a - (a[first] // reach * reach)[of_part]
    place = b % reach
    entered = np.empty(len(a), np.int64)
    entered[np.lexsort((-b, a, part))] = np.arange(len(a))
    turn = asked_first(reach)
    paid = gap * (a + b)
    score, back = np.full(len(a), float(size)), np.full(len(a), -1)
    older, here = ((np.full(room.sum(), -np.inf), np.full(room.sum(), -1)) for _ in range(2))

    def enter(maxima: tuple[np.ndarray, np.ndarray], at: np.ndarray) -> None:
        value, to = score[at] + paid[at], cell[at] + reach
        more = value > maxima[0][to]
        maxima[0][to[more]], maxima[1][to[more]] = value[more], at[more]

    def best(maxima: tuple[np.ndarray, np.ndarray], at: np.ndarray, since: int) -> tuple[np.ndarray, np.ndarray]:
        """The highest before each match; ``since`` is -1 if matches entered from the last on."""
        if len(at) > QUERIES:
            both = [best(maxima, some, since) for some in np.split(at, range(QUERIES, len(at), QUERIES))]
            return np.concatenate([x for x, _ in both]), np.concatenate([x for _, x in both])
        views = np.lib.stride_tricks.sliding_window_view(maxima[0], reach)[cell[at]]
        to = views.argmax(1)
        value, found = views[np.arange(len(at)), to], maxima[1][cell[at] + to]
        equal = views == value[:, None]
        open_ = np.flatnonzero((equal.sum(1) > 1) & (found >= 0))
        if len(open_):
            held = maxima[1][cell[at[open_], None] + np.arange(reach)]
            when = turn[place[at[open_]]]
            key = np.where(equal[open_], when * 4 * len(a) + since * entered[held], NEVER)
            # The first asked of this block or of the one before, whichever is farther on.
            sides = [np.where(side, key, NEVER) for side in (when < reach, when >= reach)]
            rows = np.arange(len(open_))
            one, two = (np.where(k.min(1) < NEVER, held[rows, k.argmin(1)], -1) for k in sides)
            found[open_] = np.maximum(one, two)
        return value, found

    order = np.argsort(level, kind="stable")
    levels = np.split(order, np.flatnonzero(np.diff(level[order])) + 1)
    number = np.array([level[at[0]] for at in levels])
    bounds = [0, *(np.flatnonzero(np.diff(number // reach)) + 1).tolist(), len(levels)]
    for w, x, y in zip([0, *bounds], bounds, bounds[1:]):
        waiting = list(range(w, x)) if w < x and number[x] // reach == number[w] // reach + 1 else []
        carried = []
        for n in range(y - 1, x - 1, -1):
            while waiting and number[waiting[-1]] >= number[n] - reach:
                enter(older, levels[waiting.pop()])
            carried.append(best(older, levels[n], -1))
        for n in range(x, y):
            at = levels[n]
            (old, old_at), (new, new_at) = carried.pop(), best(here, at, 1)
            raised, j = np.where(new >= old, new, old), np.where(new >= old, new_at, old_at)
            total = raised - paid[at] + size
            more = (j >= 0) & (total > size)
            score[at[more]], back[at[more]] = total[more], j[more]
            enter(here, at)
        for maxima, some in ((older, levels[w:x]), (here, levels[x:y])):
            for at in some:
                maxima[0][cell[at] + reach], maxima[1][cell[at] + reach] = -np.inf, -1
    return score, back


def chains_of(part: np.ndarray, a: np.ndarray, b: np.ndarray, size: int, gap: float, reach: int) -> list[list[int]]:
    """``chains`` for many parts, whose matches stand in order of ``(part, a, b)``.

    The longest parts, which would be walked on alone, are left to ``chains`` where that is less work.
    """
    if not len(a):
        return []
    first = np.flatnonzero(np.append(True, part[1:] != part[:-1]))
    n = np.diff(np.append(first, len(a)))
    long = a[first + n - 1] - a[first] + 1
    by = np.argsort(-long, kind="stable")
    alone = np.zeros(len(n), bool)
    # A step of all parts costs as much as about a dozen matches in trees.
    alone[by[: int((12 * np.append(long[by], 0) + np.append(0, np.cumsum(n[by]))).argmin())]] = True
    out = [[x + i for i in c] for x, k in zip(first[alone].tolist(), n[alone].tolist()) for c in chains(a[x : x + k], b[x : x + k], size, gap, reach)]
    together = np.flatnonzero(np.repeat(~alone, n))
    if len(together):
        score, back = scores(part[together], a[together], b[together], size, gap, reach)
        name = together.tolist()
        out += [[name[i] for i in c] for c in taken(score, back.tolist())]
    return out


def taken(score: np.ndarray, back: list[int]) -> list[list[int]]:
    """Chains by end score, each match serving once."""
    used = [False] * len(back)
    out = []
    for i in np.argsort(-score, kind="stable").tolist():
        chain = []
        while i >= 0 and not used[i]:
            used[i] = True
            chain.append(i)
            i = back[i]
        if chain:
            out.append(chain[::-1])
    return out


def same_words(left: np.ndarray, right: np.ndarray, band: int) -> int:
    """The most words that stand in both in the same order, off the diagonal by at most ``band``."""
    n, m = len(left), len(right)
    if not n or not m:
        return 0
    band = max(band, abs(n - m) + 1)
    row = np.zeros(m + 1, np.int32)
    for i in range(n):
        lo, hi = max(0, i - band), min(m, i + band + 1)
        grown = row.copy()
        grown[lo + 1 : hi + 1] = np.maximum(row[lo + 1 : hi + 1], row[lo:hi] + (right[lo:hi] == left[i]))
        row = np.maximum.accumulate(grown)
    return int(row[m])


def aligned(left: np.ndarray, right: np.ndarray, chain: np.ndarray, size: int) -> int:
    """Words of two stretches that stand in both in order; seeds at ``chain`` (k x 2) are given."""
    if len(left) == len(right) and chain[0, 0] == chain[0, 1] and np.array_equal(left, right):
        return len(left)
    same, a, b = 0, 0, 0
    off = chain[:, 0] - chain[:, 1]
    turns = np.append(np.flatnonzero(off[1:] != off[:-1]) + 1, len(off)).tolist()
    places, n = chain.tolist(), 0
    for turn in turns:
        while n < turn:
            i, j = places[n]
            n += 1
            if i < a or j < b:
                # Overlaps the seed before: what is new of it, equally much on both sides.
                skip = max(a - i, b - j)
                i, j = i + skip, j + skip
                if skip >= size:
                    continue
            else:
                skip = 0
            same += _between(left[a:i], right[b:j]) + size - skip
            a, b = i + size - skip, j + size - skip
            # The rest of the seeds at this distance, at once if all between them is equal.
            end_a, end_b = places[turn - 1][0] + size, places[turn - 1][1] + size
            if n < turn and end_a - a == end_b - b and np.array_equal(left[a:end_a], right[b:end_b]):
                same += end_a - a
                a, b, n = end_a, end_b, turn
    return same + _between(left[a:], right[b:])


def _between(left: np.ndarray, right: np.ndarray) -> int:
    """``same_words`` of what lies between the words that both begin and end with."""
    n = min(len(left), len(right))
    if not n:
        return 0
    other = left[:n] != right[:n]
    lead = int(other.argmax())
    if not other[lead]:
        return n
    other = (left[len(left) - n :] != right[len(right) - n :])[lead:][::-1]
    trail = int(other.argmax())
    if not other[trail]:
        return n
    return lead + trail + same_words(left[lead : len(left) - trail], right[lead : len(right) - trail], 16)


@dataclass(frozen=True)
class SharedPassages:
    """``min_words`` is the least length of a passage, ``likeness`` the least share of aligned words:
    what is less alike is not reported, but what is below about 0.9 may lack seeds and not be found.

    ``gap`` is the cost of a skipped word, ``reach`` the longest step within a chain,
    ``min_seeds`` the least number of matches a chain needs. Beyond its outer seeds a
    passage goes on, over single changed words too, for at most twice ``seed + window`` words.
    A key of at most ``several`` texts is matched between all of them.
    """

    seed: int = SEED
    window: int = WINDOW
    min_words: int = MIN_WORDS
    likeness: float = 0.7
    gap: float = 0.1
    reach: int = 60
    min_seeds: int = 3
    several: int = SEVERAL

    def find(self, docs: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Passages between distinct texts, and which text each row has.

        ``docs (doc_id, text)``. Passages ``(doc_id, start, end, other_id, other_start,
        other_end, n_same, likeness)``: words ``start`` to ``end`` (exclusive) of the first
        document of a text are alike to words of that of another text. Members
        ``(doc_id, first, n_words)``: for each row, the lowest ``doc_id`` with its text. A null
        text is empty; texts of fewer than ``min_words`` words have no passages.
        Repeated rows are members of one text.
        """
        docs = texts(docs)
        firsts = stored(
            docs.groupBy("version").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")),
            "firsts",
        )
        several = firsts.where("n > 1").select("version")
        few = is_small(several)
        single = docs.join(sized(several, few), "version", "left_anti").select("version", "text")
        copied = docs.join(sized(several, few), "version", "left_semi").select("version", "text").dropDuplicates(["version"])
        found = self._passages(single.unionByName(copied).withColumnRenamed("version", "node"))
        name = firsts.select(F.col("version"), "first")
        found = (
            found.join(name.toDF("a", "doc_id"), "a").join(name.toDF("b", "other_id"), "b")
            .select("doc_id", F.col("a_from").alias("start"), F.col("a_to").alias("end"), "other_id",
                    F.col("b_from").alias("other_start"), F.col("b_to").alias("other_end"), "n_same", "likeness")
        )
        count = n_words(F.col("text")).cast("long")
        alone = docs.join(sized(several, few), "version", "left_anti").select("doc_id", F.col("doc_id").alias("first"), count.alias("n_words"))
        # Counted behind the join where that moves no texts: who asks for copies only has few texts cut.
        named = sized(firsts.where("n > 1").select("version", "first", "n"), few)
        if few:
            rows = docs.join(named, "version").select("doc_id", "first", F.when(F.col("n") > 1, count).alias("n_words"))
        else:
            rows = docs.select("doc_id", "version", count.alias("n_words")).join(named, "version").select("doc_id", "first", "n_words")
        return found, alone.unionByName(rows)

    def _places(self, distinct: DataFrame) -> DataFrame:
        size, window, least = self.seed, self.window, self.min_words

        run = run_length(size, window, least)

        def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in (part for whole in batches for part in cut_rows(whole, "text", 8 * AT_ONCE)):
                h, n = word_hashes(batch.column("text"))
                long = np.flatnonzero(n >= least)
                if not len(long):
                    continue
                ends = np.cumsum(n)
                of, key, at, nth, times, gaps, starts = keys([h[ends[r] - n[r] : ends[r]] for r in long], size, window, run, least)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key.view(np.int64)), batch.column("node").take(pa.array(long[of])), *map(pa.array, (at, nth, times, gaps, starts))],
                    ["seed", "node", "pos", "nth", "times", "gaps", "starts"],
                )

        return stored(distinct.mapInArrow(cut, "seed bigint, node bigint, pos int, nth int, times int, gaps bigint, starts bigint"), "seeds")

    def _equal(self, distinct: DataFrame, held: DataFrame) -> DataFrame:
        """``(a, b, i, j, gaps)``: stretches of ``min_words`` words and more that texts share with the lowest text that has them.

        ``held`` are the places of keys of two texts and more. Each passage of ``min_words``
        words that is not monotonous (those are keys themselves) is looked at with its first
        run. The i-th place in a text is matched with the i-th of the lowest text, and in turn
        for the rest.
        """
        window, least = self.window, self.min_words
        asked = held.where("starts > 255").groupBy("node").agg(F.collect_list(F.struct("seed", "pos", "starts")).alias("places"))

        def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in (part for whole in batches for part in cut_rows(whole, "text", 8 * AT_ONCE)):
                h, n = word_hashes(batch.column("text"))
                places = batch.column("places")
                of = np.repeat(np.arange(len(n)), np.diff(places.offsets.to_numpy()))
                seed, pos, starts = (places.flatten().field(c) for c in ("seed", "pos", "starts"))
                starts = starts.to_numpy()
                first, mask = pos.to_numpy() - (starts & 255), starts >> 8
                row, number = np.nonzero((mask[:, None] >> np.arange(window)) & 1)
                start = first[row] + number
                made = shingle_hashes(h, least, (np.cumsum(n) - n)[of[row]] + start)
                bounds = pa.array(np.append(0, np.cumsum(np.bincount(row, minlength=len(pos)))), pa.int32())
                lists = [pa.ListArray.from_arrays(bounds, pa.array(x)) for x in ((start - pos.to_numpy()[row]).astype(np.int32), made.view(np.int64))]
                yield pa.RecordBatch.from_arrays([seed, batch.column("node").take(pa.array(of)), pos, *lists], ["seed", "node", "pos", "off", "h"])

        placed = (
            distinct.join(asked, "node")
            .mapInArrow(hashed, "seed bigint, node bigint, pos int, off array<int>, h array<bigint>")
            .repartition("seed")
        )
        # All that follows finds its rows where the seed put them.
        same, text = Window.partitionBy("seed", "h"), Window.partitionBy("seed", "h", "node").orderBy("at")
        rows = placed.select("seed", "node", "pos", F.inline(F.arrays_zip("off", "h"))).select("*", (F.col("pos") + F.col("off")).alias("at"))
        rows = rows.select("*", (F.row_number().over(text) - 1).alias("nth"), F.min("node").over(same).alias("lo"), F.max("node").over(same).alias("hi"))
        rows = rows.where("lo <> hi")
        lowest = F.sort_array(F.collect_list(F.when(F.expr("node = lo"), F.col("pos"))).over(same))
        rows = rows.select("*", lowest.alias("to")).where("node <> lo").select("*", F.expr("to[cast(nth % size(to) as int)]").alias("to_pos"))
        # Passages that start a word or more later in both texts overlap.
        found = rows.groupBy("seed", "node", "pos", "lo", "to_pos").agg(F.min("off").alias("first"), F.max("off").alias("last"))
        return stored(
            found.select(
                F.col("node").alias("a"), F.col("lo").alias("b"), F.expr("pos + first").alias("i"), F.expr("to_pos + first").alias("j"),
                F.expr("cast(first - last - 2 as bigint)").alias("gaps"),
            ),
            "equal",
        )

    def _passages(self, distinct: DataFrame) -> DataFrame:
        def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in (part for whole in batches for part in cut_rows(whole, "text", 8 * AT_ONCE)):
                h, n = word_hashes(batch.column("text"))
                held = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(n)), pa.int32()), pa.array(h))
                yield pa.RecordBatch.from_arrays([batch.column("node"), held], ["node", "h"])

        places = self._places(distinct.select("node", "text"))
        # Plain figures, not structs, which Spark would sort for: a key stands in a text equally often at all its places.
        ends_of = {"lo": (F.min, F.min_by), "hi": (F.max, F.max_by)}
        figures = [f for n, (end, by) in ends_of.items() for f in (end("node").alias(n), by("times", "node").alias(f"{n}_times"))]
        named = [F.struct(F.col(n).alias("node"), F.col(f"{n}_times").alias("times")).alias(n) for n in ends_of]
        shared = stored(
            places.where("nth = 0").groupBy("seed").agg(*figures, F.count("*").cast("int").alias("n")).where("lo <> hi").select("seed", *named, "n"), "shared"
        )
        # Each task holds its part of the keys, the many more places need no order.
        held = stored(places.join(shared.hint("shuffle_hash"), "seed"), "shared-places")
        equal = self._equal(distinct, held)
        # Of a key of few texts all others are matched with each other, too.
        between = held.where(F.expr("gaps >= 0 and node <> lo.node and node <> hi.node") & F.col("n").between(4, self.several))
        ends = stored(
            held.where("node = lo.node or node = hi.node").unionByName(between)
            .select("seed", F.col("node").alias("end"), F.col("nth").alias("end_nth"), F.col("pos").alias("end_pos")),
            "ends",
        )
        # The highest text's match with the lowest is asked by that one, but for places beyond its last.
        to = (
            F.when(F.expr("node = lo.node"), F.array("hi"))
            .when(F.expr("node <> hi.node"), F.array("lo", "hi"))
            .when(F.expr("nth >= lo.times"), F.array("lo"))
        )
        asked = held.select("seed", "node", "pos", "nth", "gaps", F.explode(to).alias("to"))
        others = between.where("nth = 0").select("seed", F.struct("node", "times").alias("to"))
        asked = asked.unionByName(
            between.join(others, "seed").where("node > to.node or node < to.node and nth >= to.times").select(asked.columns)
        )
        # Beyond the last place of the other text its places serve again, in two orders
        # half of them apart: what the end of one cuts in two the other holds in one piece.
        again = F.transform(F.array(F.lit(0), F.expr("to.times div 2")), lambda x: ((F.col("nth") + x) % F.col("to.times")).cast("int"))
        asked = asked.select(
            "seed", "node", "pos", "gaps", F.col("to.node").alias("end"),
            F.explode(F.when(F.expr("nth < to.times"), F.array("nth")).otherwise(F.array_distinct(again))).alias("end_nth"),
        )
        one, two = F.struct("node", "pos"), F.struct(F.col("end").alias("node"), F.col("end_pos").alias("pos"))
        matches = asked.join(ends, ["seed", "end", "end_nth"]).select(
            F.greatest(one, two).alias("x"), F.least(one, two).alias("y"), "gaps"
        )
        grouped = (
            matches.select(F.col("x.node").alias("a"), F.col("y.node").alias("b"), F.col("x.pos").alias("i"), F.col("y.pos").alias("j"), "gaps")
            .unionByName(equal)
            .groupBy("a", "b").agg(F.collect_set(F.struct("i", "j", "gaps")).alias("m"))
            .where((F.size("m") >= self.min_seeds) | F.exists("m", lambda x: x["gaps"] != 0))
        )
        size, gap, reach, least, minimum = self.seed, self.gap, self.reach, self.min_words, self.min_seeds
        edge, window = self.seed + self.window, self.window

        def long_enough(x, y) -> bool:
            return len(x) >= minimum and max(x[-1] - x[0], y[-1] - y[0]) + size + 2 * edge >= least

        def found_in(part: np.ndarray, i: np.ndarray, j: np.ndarray) -> list[list[int]]:
            made = [c for c in chains_of(part, i, j, size, gap, reach) if long_enough(i[c], j[c])]
            of = np.full(len(i), -1)
            for n, c in enumerate(made):
                of[c] = n
            # A match serves in one chain only: what that one cuts in pieces is a chain too.
            for c in diagonals(part, i, j, window):
                if long_enough(i[c], j[c]) and (of[c[0]] < 0 or (of[c] != of[c[0]]).any()):
                    made.append(c)
            return made

        def chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in (part for whole in batches for part in cut_rows(whole, "m", 3 * AT_ONCE)):
                m = batch.column("m")
                n = np.diff(m.offsets.to_numpy())
                i, j, gaps = (m.flatten().field(c).to_numpy() for c in ("i", "j", "gaps"))
                of, i, j = unpacked_of(np.repeat(np.arange(len(n)), n), i, j, gaps, size, window, least)
                if not len(i):
                    continue
                starts, plain = rising(of, i, j, size, gap, max(reach, window))
                ends = np.append(starts[1:], len(i))
                wide = [np.maximum.reduceat(x, starts) - np.minimum.reduceat(x, starts) for x in (i, j)]
                # No chain spans more than its part.
                able = (ends - starts >= minimum) & (np.maximum(*wide) + size + 2 * edge >= least)
                straight = np.flatnonzero(np.repeat(plain & able, ends - starts))
                other = np.flatnonzero(np.repeat(~plain & able, ends - starts))
                part = np.repeat(np.arange(len(starts)), ends - starts)[other]
                found = found_in(part, i[other], j[other]) if len(other) else []
                lengths = np.append((ends - starts)[plain & able], np.array([len(c) for c in found], np.int64))
                at = np.concatenate([straight, *(other[c] for c in found)])
                bounds = np.append(0, np.cumsum(lengths))
                x, y, lead, last = i[at], j[at], bounds[:-1], bounds[1:] - 1
                from_a, from_b = np.maximum(0, x[lead] - 2 * edge), np.maximum(0, y[lead] - 2 * edge)
                pair, bounds = pa.array(of[at[lead]]), pa.array(bounds, pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("a").take(pair), batch.column("b").take(pair),
                        *(pa.array(c, pa.int32()) for c in (from_a, x[last] + size + 2 * edge, from_b, y[last] + size + 2 * edge)),
                        *(pa.ListArray.from_arrays(bounds, pa.array(c - np.repeat(f, lengths), pa.int32())) for c, f in ((x, from_a), (y, from_b))),
                    ],
                    ["a", "b", "a_from", "a_to", "b_from", "b_to", "x", "y"],
                )

        chained = stored(grouped.mapInArrow(chain, MATCHES), "chains")
        asked = stored(chained.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "chain-texts")
        # Only the texts with chains are cut into words again.
        held = distinct.join(sized(asked, is_small(asked)), "node", "left_semi").select("node", "text")
        bags = stored(held.mapInArrow(hashed, "node bigint, h array<bigint>"), "chain-words")

        def part(side: str):
            return F.slice("h", F.col(f"{side}_from") + 1, F.col(f"{side}_to") - F.col(f"{side}_from")).alias(f"{side}_words")

        left = chained.join(bags.withColumnRenamed("node", "a"), "a").select(*chained.columns, part("a"))
        both = left.join(bags.withColumnRenamed("node", "b"), "b").select(*chained.columns, "a_words", part("b"))
        share = self.likeness

        def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in (part for whole in batches for part in cut_rows(whole, "a_words", 4 * AT_ONCE)):
                column = dict(zip(batch.schema.names, batch.columns))
                x, y, a_words, b_words = (flat(column[c]) for c in ("x", "y", "a_words", "b_words"))
                a, b, a_from, b_from = (column[c].to_numpy() for c in ("a", "b", "a_from", "b_from"))
                lead, length = equal_stretches(x, y, a_words, b_words, size, 2 * edge)
                whole = length >= least
                start = [f[whole] + p[0][p[1][:-1]][whole] - lead[whole] for f, p in ((a_from, x), (b_from, y))]
                out = []
                for r in np.flatnonzero(length < 0).tolist():
                    at, left, right = (np.stack([row_of(x, r), row_of(y, r)], 1), row_of(a_words, r), row_of(b_words, r))
                    asked = [(at, True)]
                    while asked:
                        at, reaches = asked.pop()
                        before, after = _reach_out(left, right, at, size) if reaches else (0, 0)
                        u = left[at[0, 0] - before : at[-1, 0] + size + after]
                        v = right[at[0, 1] - before : at[-1, 1] + size + after]
                        longest = max(len(u), len(v))
                        if longest < least:
                            continue
                        same = aligned(u, v, at - (at[0] - before), size)
                        if same >= share * longest:
                            i, j = a_from[r] + at[0, 0] - before, b_from[r] + at[0, 1] - before
                            out.append((a[r], b[r], i, i + len(u), j, j + len(v), same, same / longest))
                        elif len(at) > 1:
                            # Not alike enough as a whole: the parts beside its widest step may be. No step over equal words is one.
                            step = np.where(equal_steps(left, right, at), 0, np.diff(at, axis=0).max(1))
                            cut = int(step.argmax()) + 1
                            if step[cut - 1]:
                                asked += [(part, True) for part in (at[:cut], at[cut:]) if len(part) >= minimum]
                            elif reaches:
                                asked.append((at, False))
                n = length[whole]
                equal = [a[whole], b[whole], start[0], start[0] + n, start[1], start[1] + n, n, np.ones(len(n))]
                rest = zip(*out) if out else [()] * len(equal)
                types = [pa.int64()] * 2 + [pa.int32()] * 5 + [pa.float64()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate([e, np.asarray(r, e.dtype)]), t) for e, r, t in zip(equal, rest, types)],
                    ["a", "b", "a_from", "a_to", "b_from", "b_to", "n_same", "likeness"],
                )

        return stored(both.mapInArrow(align, FOUND), "passages")


Flat = tuple[np.ndarray, np.ndarray]  # values of all rows, and where each row begins, with the end of the last


def flat(lists: pa.ListArray) -> Flat:
    offsets = lists.offsets.to_numpy().astype(np.int64)
    return lists.flatten().to_numpy(), offsets - offsets[0]


def cut_rows(batch: pa.RecordBatch, by: str, most: int) -> Iterator[pa.RecordBatch]:
    """Pieces of a batch with about ``most`` values (of a text: bytes) in column ``by``, or of one row."""
    column = batch.column(by)
    ends = np.cumsum(pc.list_value_length(column) if pa.types.is_list(column.type) else pc.binary_length(column))
    bounds = [0, *(np.flatnonzero(np.diff(ends // most)) + 1).tolist(), batch.num_rows]
    for x, y in zip(bounds, bounds[1:]):
        yield batch.slice(x, y - x)


def row_of(rows: Flat, at: int) -> np.ndarray:
    return rows[0][rows[1][at] : rows[1][at + 1]]


def equal_stretches(x: Flat, y: Flat, left: Flat, right: Flat, size: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """How far each chain reaches out before its first seed, and its whole length if its two stretches are equal, else -1.

    Chains ``x, y`` hold places of seeds in the words ``left, right``, which begin and end at most
    ``most`` words beyond the outer seeds. Reaches as ``_reach_out``; what is equal on both
    sides is aligned as it stands.
    """
    first, last = x[1][:-1], x[1][1:] - 1
    a, b = x[0][first], y[0][first]
    end_a, end_b = x[0][last] + size, y[0][last] + size
    start_a, start_b = left[1][:-1], right[1][:-1]

    def reached(at_a: np.ndarray, at_b: np.ndarray, room: np.ndarray, way: int) -> tuple[np.ndarray, np.ndarray]:
        """How many words belong to the passage from these on, and whether all of them are equal."""
        step = np.arange(most)
        inside = step < room[:, None]
        i, j = (np.where(inside, p[:, None] + way * step, 0) for p in (at_a, at_b))
        same = inside & (left[0][i] == right[0][j]) if len(left[0]) and len(right[0]) else inside
        total = np.cumsum(np.where(same, 1, -UNLIKE), axis=1)
        n = np.where(total.max(1) > 0, total.argmax(1) + 1, 0)
        return n, np.append(np.zeros((len(n), 1), bool), ~same, axis=1).cumsum(1)[np.arange(len(n)), n] == 0

    lead, plain = reached(start_a + a - 1, start_b + b - 1, np.minimum(a, b), -1)
    room = np.minimum(np.diff(left[1]) - end_a, np.diff(right[1]) - end_b)
    trail, alike = reached(start_a + end_a, start_b + end_b, np.maximum(0, room), 1)
    core = np.where(plain & alike & (end_a - a == end_b - b), end_a - a, 0)
    # Equal words between the outer seeds, of all rows at once.
    row = np.repeat(np.arange(len(core)), core)
    place = np.arange(len(row)) - np.repeat(np.cumsum(core) - core, core)
    other = left[0][(start_a + a)[row] + place] != right[0][(start_b + b)[row] + place]
    core[row[other]] = 0
    return lead, np.where(core > 0, lead + core + trail, -1)


def equal_steps(left: np.ndarray, right: np.ndarray, chain: np.ndarray) -> np.ndarray:
    """Whether the words from each match of a chain to the next are the same on both sides."""
    off = chain[:, 0] - chain[:, 1]
    out = off[1:] == off[:-1]
    for n in np.flatnonzero(out).tolist():
        (i, j), (end, _) = chain[n].tolist(), chain[n + 1].tolist()
        out[n] = np.array_equal(left[i:end], right[j : j + end - i])
    return out


def _reach_out(left: np.ndarray, right: np.ndarray, chain: np.ndarray, size: int) -> tuple[int, int]:
    """How many words before the first and after the last seed belong to the passage."""
    i, j = chain[0]
    n = min(i, j)
    lead = _grown(left[i - n : i][::-1] == right[j - n : j][::-1])
    i, j = chain[-1] + size
    n = max(0, min(len(left) - i, len(right) - j))
    return lead, _grown(left[i : i + n] == right[j : j + n])


def _grown(same: np.ndarray) -> int:
    """The length with the most equal words less ``UNLIKE`` for each other word."""
    total = np.cumsum(np.where(same, 1, -UNLIKE))
    return int(total.argmax()) + 1 if len(total) and total.max() > 0 else 0
