"""Near-duplicate lines by a segment-partition edit join.

Lines are alike when their edit distance is within the edits that the shorter
one's length allows (``edits_allowed``).  A line that is ``t`` edits from
another shares one of its ``t + 1`` segments with it, at nearly the same place:

1. every line indexes its own segments and probes the segments of lines that
   are as long or up to ``t`` shorter (the multi-match-aware choice of
   substrings, a dozen for two edits).  Substrings travel as hashes;
2. lines that meet under a segment form a candidate set; equal sets count once;
3. texts are fetched for those lines alone and pairs are verified with a
   banded bit-parallel edit distance, many pairs at a time;
4. links give components, and of each component the first occurrence (smallest
   doc_id, then line) stays.

A segment that very many lines share (a template) would give a quadratic
number of pairs.  Such sets are cut by finer signatures first: two edits leave
all but two of ``FINE`` segments alone, so lines within two edits agree in the
text around some two segments.  This is exact, in place for sets of up to
``GIANT`` lines or about ``POINTS`` code points and as further distributed
rounds beyond them.

Lines that vary in one place (a number in a template) still meet under one
finer signature.  More than ``RUN`` of them are never paired.  The part that
differs is split again in the same way (``_finer``: one with two edits into
``FINE`` segments, one of two with an edit each into halves), round by round,
until lines no longer meet, few do, or the part has at most ``SHORT`` code
points.  Only such short parts give variants (``variants``: one edit undone in
each of two, or two in one): lines with an equal variant hang on the first of
them, and each such link is within the allowed edits.  Rows grow with the
lines and the rounds (the logarithm of the length), not with pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .common import SPACES, connected_components, written
from .simhash import _forest

MAX_EDITS = 2
CHARS_PER_EDIT = 10
FINE = 6
PLAIN_SET = 64
GIANT = 20_000
RUN = 256
#: Code points of a set that one task takes; and of a differing part that gives variants.
POINTS = 8_000_000
SHORT = 24
CHUNK = 1_000_000
#: Code points (and 100 a line) of candidate sets that are verified together.
HELD = 1_000_000

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_BASE_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))


def edits_allowed(n):
    """Edits for a line of n code points: one for every ten, two at most."""
    return np.minimum(MAX_EDITS, np.asarray(n) // CHARS_PER_EDIT)


def _mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h = h ^ (h >> np.uint64(29))
    return h * np.uint64(0xC2B2AE3D27D4EB4F) ^ (h >> np.uint64(32))


class _Hashes:
    """Substring hashes of many lines at once: one prefix sum, two look-ups for a substring."""

    def __init__(self, lines: list[str]):
        self.n = np.array([len(x) for x in lines], np.int64)
        self.at = np.concatenate([[0], np.cumsum(self.n)])[:-1]
        code = np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64) + np.uint64(1)
        with np.errstate(over="ignore"):
            up = np.multiply.accumulate(np.r_[np.uint64(1), np.full(len(code), _BASE)])
            self.down = np.multiply.accumulate(np.r_[np.uint64(1), np.full(len(code), _BASE_INVERSE)])
            self.sum = np.r_[np.uint64(0), np.cumsum(code * up[:-1], dtype=np.uint64)]

    def of(self, i: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        s, e = self.at[i] + start, self.at[i] + end
        return (self.sum[e] - self.sum[s]) * self.down[s]


def _segment(n: np.ndarray, parts: int, i: int) -> tuple[np.ndarray, np.ndarray]:
    """Start and length of segment i of lines of n code points; the last ones are the longer ones."""
    base, rest = n // parts, n % parts
    first_long = parts - rest
    return i * base + np.maximum(0, i - first_long), base + (i >= first_long)


def _tagged(h: np.ndarray, *tags, probe: bool) -> np.ndarray:
    for t in tags:
        h = _mix(h + np.asarray(t).astype(np.uint64) * np.uint64(0xA24BAED4963EE407) + np.uint64(0x632BE59BD9B4E019))
    return (h & ~np.uint64(1)) | np.uint64(probe)


def _sealed(sig: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The signature with the power of two below n in bits 1 to 5: a set's size in code points follows from it."""
    power = np.log2(np.maximum(n, 1)).astype(np.uint64)
    return (sig & ~np.uint64(62)) | np.minimum(power, np.uint64(31)) << np.uint64(1)


def _most(power: int) -> int:
    """Lines of a set that one task takes, their length being under twice that power of two."""
    return max(2, min(GIANT, POINTS >> (power + 1)))


def coarse_signatures(lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(signature, line number); the lowest bit tells a probe (1) from an indexed segment (0)."""
    h = _Hashes(lines)
    sig, who = [], []
    with np.errstate(over="ignore"):
        for t in range(1, MAX_EDITS + 1):
            own = np.flatnonzero(edits_allowed(h.n) == t)
            for i in range(t + 1):
                start, size = _segment(h.n[own], t + 1, i)
                sig.append(_sealed(_tagged(h.of(own, start, start + size), h.n[own], i, probe=False), h.n[own]))
                who.append(own)
            for longer in range(t + 1):
                r = np.flatnonzero(edits_allowed(np.maximum(h.n - longer, 0)) == t)
                n = h.n[r] - longer
                for i in range(t + 1):
                    p, size = _segment(n, t + 1, i)
                    for shift in range(max(-i, longer - (t - i)), min(i, longer + (t - i)) + 1):
                        start = p + shift
                        ok = (start >= 0) & (start + size <= h.n[r])
                        sig.append(_sealed(_tagged(h.of(r[ok], start[ok], (start + size)[ok]), n[ok], i, probe=True), n[ok]))
                        who.append(r[ok])
    return np.concatenate(sig), np.concatenate(who)


def fine_signatures(lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Signatures of a line's text around any one or two of FINE segments (see the module's text)."""
    return _fine_places(lines)[:2]


def _fine_places(lines: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The fine signatures and, as one number, where each leaves the text open (``_open_parts``)."""
    h = _Hashes(lines)
    allowed = [edits_allowed(np.maximum(h.n - longer, 0)) for longer in range(MAX_EDITS + 1)]
    return _fine_rows(h, np.flatnonzero(allowed[0] >= 1),
                      [np.flatnonzero((t >= 1) & (t >= longer)) for longer, t in enumerate(allowed)])


def _fine_rows(h: _Hashes, indexed: np.ndarray, probes: list[np.ndarray], two: np.ndarray | None = None):
    """Signatures, row numbers and places of the indexed rows and of the probes that are 0, 1 … code points longer.

    ``two``: which rows may have two edits; the others open one segment only,
    and probes that repeat an indexed row's own signature are left out.
    """
    sig, who, place = [], [], []

    def add(r, n, longer, p, q, move, probe):
        a, size_p = _segment(n, FINE, p)
        b, size_q = _segment(n, FINE, q)
        total = n + longer
        head = h.of(r, np.zeros_like(a), a)
        tail = h.of(r, np.minimum(b + size_q + longer, total), total)
        key = _tagged(head, n, p, q, probe=False) * np.uint64(3) + _tagged(tail, p, q, probe=False)
        if p != q:
            lo, hi = a + size_p + move, b + move
            ok = (lo >= 0) & (lo <= hi) & (hi <= total)
            key = key[ok] * np.uint64(5) + _tagged(h.of(r[ok], lo[ok], hi[ok]), p, q, probe=False)
            r, n = r[ok], n[ok]
        sig.append(_sealed(_tagged(key, n, probe=probe), n))
        who.append(r)
        place.append(np.full(len(r), (((p * FINE + q) * 4 + longer) * 4 + move + 1) * 2 + probe, np.int64))

    with np.errstate(over="ignore"):
        for p in range(FINE):
            for q in range(p, FINE):
                fit = (lambda r: r) if two is None or p == q else (lambda r: r[two[r]])
                own = fit(indexed)
                add(own, h.n[own], 0, p, q, 0, False)
                for longer in range(MAX_EDITS + 1):
                    r = fit(probes[longer])
                    for move in ([0] if p == q else range(max(-1, longer - 1), min(1, longer + 1) + 1)):
                        if two is None or longer or move:
                            add(r, h.n[r] - longer, longer, p, q, move, True)
    return np.concatenate(sig), np.concatenate(who), np.concatenate(place)


def _place(place: int) -> tuple[int, int, int, int, bool]:
    """p, q, longer, move and probe of a fine signature's place."""
    pq, rest = divmod(place, 32)
    return pq // FINE, pq % FINE, rest // 8, rest // 2 % 4 - 1, bool(rest & 1)


def _open_parts(line: str, place: int) -> tuple[str, str]:
    """The text that a fine signature leaves open: segment p and, if it is another one, segment q."""
    p, q, longer, move, _ = _place(place)
    n = len(line) - longer
    start = lambda i: i * (n // FINE) + max(0, i - (FINE - n % FINE))
    a, a_end, b, b_end = start(p), start(p + 1), start(q), start(q + 1)
    if p == q:
        return line[a:a_end + longer], ""
    return line[a:a_end + move], line[b + move:b_end + longer]


def _shared(low: str, high: str) -> int:
    """Length of the common start of all strings between two in sorted order."""
    return next((i for i, (x, y) in enumerate(zip(low, high)) if x != y), min(len(low), len(high)))


def _ends(low: str, high: str, low_back: str, high_back: str, shortest: int) -> tuple[int, int]:
    """What a group's parts share in front and behind, from its smallest and largest part, also read backwards."""
    head = _shared(low, high)
    return head, min(_shared(low_back, high_back), shortest - head)


def _without(s: str) -> list[str]:
    return [s[:i] + s[i + 1:] for i in range(len(s))]


def _masked(s: str) -> list[str]:
    return [f"{i}:{s[:i]}{s[i + 1:]}" for i in range(len(s))]


def variants(x: str, y: str, place: int, allowed: int) -> set[str]:
    """Keys of a line's open parts: lines with the same key, one of them indexed, are within ``allowed`` edits of that one.

    All pairs within ``allowed`` edits whose edits lie in the open parts share
    a key.  Segments p and q take one edit each, a segment on its own all.
    An indexed line serves probes of any length, a probe those of its own.
    """
    p, q, longer, move, probe = _place(place)
    out: set[str] = set()
    if probe and longer == 0 and (p == q or move == 0):
        return out  # the same line's indexed keys
    if p != q:
        if allowed < 2:
            return out

        def side(s: str, change: int) -> list[str]:
            return _masked(s) if change == 0 else [s] if (change < 0) == probe else _without(s)

        for dx, dy in [(move, longer - move)] if probe else [(0, 0), (0, 1), (1, 0), (1, 1), (1, -1), (-1, 1)]:
            right = side(y, dy)
            out.update(f"{dx}{dy}|{len(u)}|{u}{v}" for u in side(x, dx) for v in right)
        return out
    if not probe:
        out.add(f"exact|{x}")
        out.update("one|" + u for u in _masked(x))
        if allowed > 1:
            out.update("gap|" + u for u in _without(x))
            out.update(f"two|{i}:{j}:{x[:i]}{x[i + 1:j]}{x[j + 1:]}" for j in range(len(x)) for i in range(j))
    elif longer <= allowed:
        shorter = set(_without(x))
        if longer == 2:
            shorter = {v for u in shorter for v in _without(u)}
        elif allowed > 1:
            out.update("one|" + v for u in shorter for v in _masked(u))
        out.update("exact|" + u for u in shorter)
    return out


def _is_short(x: str, y: str, place: int) -> bool:
    """Whether the open parts of an indexed line with the same signature are short enough for variants."""
    p, q, longer, move, _ = _place(place)
    return len(x) - (longer if p == q else move) <= SHORT and (p == q or len(y) - (longer - move) <= SHORT)


def _finer(xs: list[str], ys: list[str], place: list[int], allowed: list[int], keys: np.ndarray):
    """Signatures of open parts, one round finer: keys, row numbers, places and sides (for ``_finer_parts``).

    Two rows of one key in ``keys``, one of them indexed, that are within the
    allowed edits in their open parts get an equal key.  A part with all edits
    is treated like a line (side 4).  Of two parts with an edit each, a half of
    each is closed; a short one stays open (side in base 3: left, right or all).
    """
    at = np.array([_place(c) for c in place], np.int64).reshape(-1, 5)
    p, q, longer, move, probe = at.T
    k = np.asarray(allowed, np.int64)
    use = ~((probe == 1) & (longer == 0) & ((p == q) | (move == 0)))  # else the same line's indexed row
    old = np.asarray(place, np.int64)
    out = []
    with np.errstate(over="ignore"):
        one = np.flatnonzero(use & (p == q))
        if len(one):
            h = _Hashes([xs[i] for i in one])
            indexed, more = probe[one] == 0, longer[one]
            sig, who, new = _fine_rows(h, np.flatnonzero(indexed), [
                np.flatnonzero(indexed if d == 0 else ~indexed & (more == d)) for d in range(MAX_EDITS + 1)], k[one] > 1)
            out.append((sig, one[who], new, np.full(len(sig), -1, np.int64)))
        two = np.flatnonzero(use & (p != q) & (k > 1))
        if len(two):
            dx = np.where(probe[two] == 1, move[two], 0)
            sides = []
            for parts, d in ((xs, dx), (ys, np.where(probe[two] == 1, longer[two], 0) - dx)):
                h = _Hashes([parts[i] for i in two])
                n, r = h.n - d, np.arange(len(two))
                m, long = n // 2, n > SHORT
                sides.append([(h.of(r, np.maximum(m + d, 0), h.n), n, long), (h.of(r, np.zeros_like(m), m), n, long),
                              (np.zeros(len(two), np.uint64), n, ~long)])
            for a, (left, n_x, ok_x) in enumerate(sides[0]):
                for b, (right, n_y, ok_y) in enumerate(sides[1]):
                    ok = ok_x & ok_y
                    key = _tagged(left, n_x, a, b, probe=False) * np.uint64(3) + _tagged(right, n_y, a, b, probe=False)
                    out.append((_mix(key[ok]), two[ok], old[two[ok]], np.full(int(ok.sum()), 3 * a + b, np.int64)))
        if not out:
            return np.zeros(0, np.int64), *(np.zeros(0, np.int64) for _ in range(3))
        sig, who, new, side = (np.concatenate(c) for c in zip(*out))
        own = keys[who].astype(np.uint64)
        key = _tagged(sig >> np.uint64(1), own, probe=False) >> np.uint64(1)
        key = (key & ~np.uint64(31)) | (own & np.uint64(31))  # a line's length goes with it
    return key.view(np.int64), who, new, side


def _finer_parts(x: str, y: str, place: int, new: int, side: int) -> tuple[str, str]:
    """What a signature of ``_finer`` leaves open of the parts x and y that were open under ``place``."""
    if side < 0:
        return _open_parts(x, new)
    _, _, longer, move, probe = _place(place)
    out = []
    for s, d, way in ((x, move if probe else 0, side // 3), (y, longer - move if probe else 0, side % 3)):
        m = (len(s) - d) // 2
        out.append(s if way == 2 else s[m:] if way else s[:max(m + d, 0)])
    return out[0], out[1]


# ----------------------------------------------------------------- verification


def _codes(s: str) -> np.ndarray:
    return np.frombuffer(s.encode("utf-32-le", "surrogatepass"), "<u4")


def _trim(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    n = min(len(a), len(b))
    d = np.flatnonzero(a[:n] != b[:n])
    head = int(d[0]) if len(d) else n
    a, b, n = a[head:], b[head:], n - head
    if n:
        d = np.flatnonzero(a[len(a) - n:][::-1] != b[len(b) - n:][::-1])
        tail = int(d[0]) if len(d) else n
        a, b = a[:len(a) - tail], b[:len(b) - tail]
    return a, b


def within_edits(pairs: list[tuple[np.ndarray, np.ndarray, int]]) -> np.ndarray:
    """Whether each pair of code point arrays is within its number of edits.

    Banded bit-parallel edit distance: the ``2 k + 1`` diagonals around the main
    one are the bits of a word, one step for each code point of the longer
    line, all pairs in step.  Pairs that are over their limit drop out.
    """
    out = np.zeros(len(pairs), bool)
    cores, ids = [], []
    for i, (a, b, k) in enumerate(pairs):
        if len(a) > len(b):
            a, b = b, a
        if len(b) - len(a) > k:
            continue
        a, b = _trim(a, b)
        if len(a) == 0:
            out[i] = len(b) <= k
        else:
            cores.append((a, b, k))
            ids.append(i)
    order = np.argsort([len(b) for _, b, _ in cores], kind="stable")
    s = 0
    while s < len(order):
        e, widest = s, 0
        while e < len(order) and (e == s or (e - s + 1) * max(widest, len(cores[order[e]][1])) <= 1_000_000):
            widest = max(widest, len(cores[order[e]][1]))
            e += 1
        part = [cores[j] for j in order[s:e]]
        out[[ids[j] for j in order[s:e]]] = _banded(part)
        s = e
    return out


def _banded(part: list[tuple[np.ndarray, np.ndarray, int]]) -> np.ndarray:
    """The band of MAX_EDITS diagonals either side; a (shorter) runs down, b (longer) across."""
    k, count = MAX_EDITS, len(part)
    n_a = np.array([len(a) for a, _, _ in part])
    n_b = np.array([len(b) for _, b, _ in part])
    limit = np.array([x for _, _, x in part])
    across = int(n_b.max())
    # a with k fillers in front: column j of the band sees a[j-k .. j+k]
    down = np.full((count, across + 2 * k + 1), 0xFFFFFFFF, np.uint32)
    text = np.full((count, across), 0xFFFFFFFE, np.uint32)
    for i, (a, b, _) in enumerate(part):
        down[i, k:k + len(a)] = a
        text[i, :len(b)] = b
    # Vertical differences down the band of column 0: the rows above the table count as free
    # fill-ins, D[i][0] = |i|, so bits of rows 1..k are +1 and those above row 0 are -1.
    one = np.uint32(1)
    width = 2 * k + 1
    full = np.uint32((1 << width) - 1)
    vp = np.full(count, ((1 << (k + 1)) - 1) << k & int(full), np.uint32)
    vn = np.full(count, (1 << k) - 1, np.uint32)
    low = np.full(count, k, np.int64)  # D at the lowest row of the band
    result = np.full(count, MAX_EDITS + 1, np.int64)
    live = np.arange(count)
    for j in range(across):
        # moving one column right moves the band one row down: bit d is row j + 1 + d - k
        match = np.zeros(len(live), np.uint32)
        for d in range(width):
            match |= (down[live, j + d] == text[live, j]).astype(np.uint32) << np.uint32(d)
        d0 = ((((match & vp) + vp) ^ vp) | match | vn) & full
        hp = (vn | ~(d0 | vp)) & full
        hn = d0 & vp
        low += 1 - ((d0 >> np.uint32(width - 1)) & one).astype(np.int64)
        shifted = d0 >> one
        vp = (hn | ~(shifted | hp)) & full
        vn = shifted & hp & full
        ends = n_b[live] == j + 1
        if ends.any():
            at = np.flatnonzero(ends)
            # from the band's lowest row up to the last row of a
            rows = j + 1 + k - n_a[live[at]]
            value = low[at].copy()
            v_p, v_n = vp[at], vn[at]
            for up in range(2 * k + 1):
                step = rows > up
                bit = np.uint32(max(width - 2 - up, 0))
                value -= np.where(step, ((v_p >> bit) & one).astype(np.int64) - ((v_n >> bit) & one).astype(np.int64), 0)
            result[live[at]] = value
        if ends.any() or j % 8 == 7:
            # D at the lowest row, less what the band can give back, is a bound from below
            stay = ~ends & (low - 2 * k <= limit[live])
            if not stay.all():
                live, vp, vn, low = live[stay], vp[stay], vn[stay], low[stay]
                if not len(live):
                    break
    return result <= limit


def _hung(lines: list[str], who: list[int], place: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i < j) that connect the lines of one fine signature: few are paired, many go by the part that differs."""
    n = len(lines)
    allowed = [int(edits_allowed(len(lines[i]) - _place(c)[2])) for i, c in zip(who, place)]
    xs, ys = (list(c) for c in zip(*(_open_parts(lines[i], c) for i, c in zip(who, place))))
    todo = [(who, place, allowed, xs, ys)]
    found: set[int] = set()
    paired: list[np.ndarray] = []
    seen: set[tuple[int, ...]] = set()
    while todo:
        who, place, allowed, xs, ys = todo.pop()
        members = np.unique(who)
        if len(members) <= RUN:
            if (own := tuple(members.tolist())) not in seen:
                seen.add(own)
                i, j = np.triu_indices(len(members), 1)
                paired.append(members[i] * n + members[j])
            continue
        (h, t), (h2, t2) = (_ends(min(side), max(side), min(back), max(back), min(map(len, side)))
                            for side, back in ((side, [x[::-1] for x in side]) for side in (xs, ys)))
        p, q, *_ = _place(place[0])
        xs, ys = [x[h:len(x) - t] for x in xs], [y[h2:len(y) - t2] for y in ys]
        if not any(xs) or p != q and not any(ys):
            continue  # another signature has them
        if _is_short(xs[0], ys[0], place[0]):
            first: dict[str, int] = {}
            for wanted in (0, 1):
                for i, c, k, x, y in zip(who, place, allowed, xs, ys):
                    if c & 1 == wanted:
                        for v in variants(x, y, c, k):
                            j = first.get(v, i) if wanted else first.setdefault(v, i)
                            if i != j:
                                found.add(min(i, j) * n + max(i, j))
            continue
        key, row, new, side = _finer(xs, ys, place, allowed, np.zeros(len(xs), np.uint64))
        order = np.argsort(key, kind="stable")
        cuts = np.flatnonzero(np.diff(key[order])) + 1
        for group in np.split(order, cuts):
            rows = row[group].tolist()
            if len({who[r] for r in rows}) > 1 and not (new[group] & 1).all():
                parts = [_finer_parts(xs[r], ys[r], place[r], c, d)
                         for r, c, d in zip(rows, new[group].tolist(), side[group].tolist())]
                todo.append(([who[r] for r in rows], new[group].tolist(), [allowed[r] for r in rows],
                             [x for x, _ in parts], [y for _, y in parts]))
    pairs = np.unique(np.concatenate([np.array(sorted(found), np.int64), *paired]))
    return pairs // n, pairs % n


def _set_pairs(lines: list[str], fine: bool) -> tuple[np.ndarray, np.ndarray]:
    """Candidate pairs (i < j) of one set; large sets go through the fine signatures."""
    n = len(lines)
    if n <= PLAIN_SET or fine:
        return np.triu_indices(n, 1)
    sig, who, place = _fine_places(lines)
    order = np.lexsort((who, sig >> np.uint64(1)))
    key, who, place = (sig >> np.uint64(1))[order], who[order], place[order]
    new = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    seen: set[tuple[int, ...]] = set()
    a, b = [], []
    for s, e in zip(new.tolist(), np.append(new[1:], len(key)).tolist()):
        if e - s > 1:
            members = np.unique(who[s:e])
            if len(members) > RUN:
                i, j = _hung(lines, who[s:e].tolist(), place[s:e].tolist())
                a.append(i)
                b.append(j)
            elif len(members) > 1 and (own := tuple(members.tolist())) not in seen:
                seen.add(own)
                i, j = np.triu_indices(len(members), 1)
                a.append(members[i])
                b.append(members[j])
    if not a:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    pairs = np.unique(np.concatenate(a) * n + np.concatenate(b))
    return pairs // n, pairs % n


def _links_in_sets(sets: list[tuple[list[str], list[str], bool]]) -> list[tuple[str, str]]:
    """Links (of line keys) in candidate sets, verified together; a forest for each set."""
    todo, where = [], []
    codes: dict[str, np.ndarray] = {}
    size = 0  # code points in ``codes``
    out: list[tuple[str, str]] = []

    def flush():
        ok = within_edits(todo)
        by_set: dict[int, list[tuple[str, str]]] = {}
        for good, (s, x, y) in zip(ok.tolist(), where):
            if good:
                by_set.setdefault(s, []).append((x, y))
        for links in by_set.values():
            names = sorted({x for p in links for x in p})
            number = {x: i for i, x in enumerate(names)}
            out.extend((names[i], names[j]) for i, j in _forest(
                np.array([number[x] for x, _ in links]), np.array([number[y] for _, y in links])))
        todo.clear()
        where.clear()
        codes.clear()

    for s, (keys, lines, fine) in enumerate(sets):
        left, right = _set_pairs(lines, fine)
        for i, j in zip(left.tolist(), right.tolist()):
            short, long = sorted((len(lines[i]), len(lines[j])))
            k = int(min(MAX_EDITS, short // CHARS_PER_EDIT))
            if keys[i] == keys[j] or long - short > k or k == 0:
                continue
            for x in (i, j):
                if keys[x] not in codes:
                    codes[keys[x]] = _codes(lines[x])
                    size += len(lines[x])
            todo.append((codes[keys[i]], codes[keys[j]], k))
            where.append((s, keys[i], keys[j]))
            if len(todo) >= 20_000 or size >= 4 * HELD:
                flush()
                size = 0
    flush()
    return out


# --------------------------------------------------------------------- Spark jobs


def _line_id(line: str) -> int:
    import xxhash

    h = xxhash.xxh64_intdigest(line.encode("utf-8", "surrogatepass"), 42)  # as Spark's xxhash64
    return h - (1 << 64) if h >> 63 else h


def signatures(lines: DataFrame, kind: str, split: bool) -> DataFrame:
    """Rows (sig, id) for all lines of a text column (``split``: whole texts, cut at line feeds).

    ``kind``: coarse, or fine, which adds each signature's ``place``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = coarse_signatures if kind == "coarse" else _fine_places
        seen: set[int] = set()  # a hot line is written once for each task, not for each occurrence

        def out(chunk: list[str], ids: list[int]):
            sig, who, *place = make(chunk)
            columns = [sig.view(np.int64), np.array(ids, np.int64)[who], *place]
            for s in range(0, len(sig), 500_000):
                yield pa.RecordBatch.from_arrays([pa.array(c[s:s + 500_000]) for c in columns],
                                                 names=["sig", "id", "place"][:len(columns)])

        chunk, ids, size = [], [], 0
        for b in batches:
            for text in b.column(0):
                text = text.as_py()
                if text is None:
                    continue
                for line in text.split("\n") if split else [text]:
                    if len(line) < CHARS_PER_EDIT or not line.strip(SPACES):
                        continue
                    i = _line_id(line)
                    if i in seen:
                        continue
                    if len(seen) > 500_000:
                        seen.clear()
                    seen.add(i)
                    chunk.append(line)
                    ids.append(i)
                    size += len(line)
                    if size >= CHUNK:
                        yield from out(chunk, ids)
                        chunk, ids, size = [], [], 0
        if chunk:
            yield from out(chunk, ids)

    return lines.mapInArrow(run, "sig long, id long" + (", place long" if kind == "fine" else ""))


def candidate_sets(sigs: DataFrame) -> DataFrame:
    """Sets of two or more lines under one signature: rows (set, n, id), equal sets once.

    Rows arrive sorted by signature, so a set is a run; a run is held as its
    distinct ids only.  A run of over ``GIANT`` lines is not held: it goes on
    as it arrives, under its signature and with ``n`` of GIANT + 1.  Sets of
    more lines than a task takes (``_most``) carry that ``n`` too.
    """
    parts = (sigs.withColumn("key", F.shiftrightunsigned("sig", 1)).repartition("key").drop("key")
             .sortWithinPartitions(F.shiftrightunsigned("sig", 1), "sig", "id"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        def found(sig, ids):
            if not len(sig):
                return
            key = sig >> np.uint64(1)
            new = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            size = np.diff(np.append(new, len(key)))
            indexed = (sig[new] & np.uint64(1)) == 0
            use = (size > 1) & indexed
            s_out, n_out, i_out = [], [], []
            for s, n, power in zip(new[use].tolist(), size[use].tolist(), (key[new[use]] & np.uint64(31)).tolist()):
                m = np.unique(ids[s:s + n])
                if len(m) > 1:
                    h = xxhash.xxh64_intdigest(m.tobytes())
                    s_out.append(np.full(len(m), h, np.uint64).view(np.int64))
                    n_out.append(np.full(len(m), len(m) if len(m) <= _most(power) else GIANT + 1, np.int64))
                    i_out.append(m)
            if s_out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (s_out, n_out, i_out)],
                                                 names=["set", "n", "id"])

        def passed(key, ids):
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), x, np.int64)) for x in (key.view(np.int64), GIANT + 1)]
                                              + [pa.array(ids)], names=["set", "n", "id"])

        hold_s, hold_i = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        hot, hot_indexed = None, False
        for b in batches:
            sig = b.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            ids = b.column(1).to_numpy(zero_copy_only=False)
            if hot is not None and len(sig):
                n = int(np.searchsorted(sig >> np.uint64(1) != hot, True))
                if hot_indexed and n:
                    yield passed(hot, ids[:n])
                sig, ids = sig[n:], ids[n:]
                if len(sig):
                    hot = None
            sig, ids = np.concatenate([hold_s, sig]), np.concatenate([hold_i, ids])
            if not len(sig):
                continue
            fresh = np.r_[True, (sig[1:] != sig[:-1]) | (ids[1:] != ids[:-1])]
            sig, ids = sig[fresh], ids[fresh]
            key = sig >> np.uint64(1)
            other = np.flatnonzero(key != key[-1])
            cut = int(other[-1]) + 1 if len(other) else 0
            yield from found(sig[:cut], ids[:cut])
            hold_s, hold_i = sig[cut:], ids[cut:]
            if len(hold_s) > 2 * GIANT:  # a line has two rows at most under a signature
                hot, hot_indexed = key[-1], (hold_s[0] & np.uint64(1)) == 0
                if hot_indexed:
                    yield passed(hot, hold_i)
                hold_s, hold_i = hold_s[:0], hold_i[:0]
        yield from found(hold_s, hold_i)

    return parts.mapInArrow(run, "set long, n long, id long").distinct()


def _with_text(sets: DataFrame, docs: DataFrame, text_col: str) -> DataFrame:
    """Rows (set, n, id, key, line): the texts of the lines in sets.

    A first sieve of fixed size (which of 2**20 remainders occur among the ids,
    so at most that many numbers are broadcast) keeps most other lines out of
    the shuffle that then joins on the ids themselves.
    """
    wanted = sets.select(F.pmod("id", F.lit(1 << 20)).cast("int").alias("tl_r")).distinct()
    lines = (docs.select(F.explode(F.split(text_col, "\n")).alias("line"))
             .withColumn("lid", F.xxhash64("line"))
             .join(F.broadcast(wanted), F.pmod("lid", F.lit(1 << 20)).cast("int") == F.col("tl_r"), "left_semi"))
    ids = sets.select(F.col("id").alias("lid")).distinct()
    texts = (lines.withColumn("key", _key("line")).groupBy("lid", "key").agg(F.first("line").alias("line"))
             .join(ids, "lid", "left_semi"))
    return sets.join(texts, F.col("id") == F.col("lid")).select("set", "n", "id", "key", "line")


def _key(line):
    """A line's identity: 128 bits of hash as text."""
    return F.concat(F.lpad(F.hex(F.xxhash64(line)), 16, "0"), F.lpad(F.hex(F.xxhash64(F.lit("2"), line)), 16, "0"))


def _verified(members: DataFrame, fine: bool) -> DataFrame:
    """Links (a, b) of line keys within the candidate sets."""
    parts = members.select("set", "key", "line").repartition("set").sortWithinPartitions("set", "key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(sets):
            found = _links_in_sets(sets)
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in found]), pa.array([y for _, y in found])],
                                                 names=["a", "b"])

        own, keys, lines, ready, held = None, [], [], [], 0
        for b in batches:
            for s, k, t in zip(*b.columns):  # one line at a time: a batch's list of lines has no bound in bytes
                s, k, t = s.as_py(), k.as_py(), t.as_py()
                if s != own:
                    if len(keys) > 1:
                        ready.append((keys, lines, fine))
                        held += sum(map(len, lines)) + 100 * len(lines)
                    if held >= HELD:
                        yield from out(ready)
                        ready, held = [], 0
                    own, keys, lines = s, [], []
                keys.append(k)
                lines.append(t)
        if len(keys) > 1:
            ready.append((keys, lines, fine))
        yield from out(ready)

    return parts.mapInArrow(run, "a string, b string")


def _crowded(rows: str = "rows", key: str = "sig_key"):
    """Whether a signature with so many rows (two a line at most) holds more lines than are paired."""
    points = f"shiftright({POINTS}L, cast({key} & 31 as int) + 1)"
    return F.expr(f"{rows} > 2 * least({RUN}, greatest(2, {points}))")


_OPEN = "sig_key long, id long, place long, allowed int, x string, y string"


def _opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The open parts of lines: rows sig_key, id, place, line."""
    for b in batches:
        allowed, xs, ys = [], [], []
        for place, line in zip(b.column(2).to_pylist(), b.column(3)):
            line = line.as_py()
            x, y = _open_parts(line, place)
            allowed.append(int(edits_allowed(len(line) - _place(place)[2])))
            xs.append(x)
            ys.append(y)
        yield pa.RecordBatch.from_arrays(
            [b.column(0), b.column(1), b.column(2), pa.array(allowed, pa.int32()), pa.array(xs, pa.string()),
             pa.array(ys, pa.string())], names=["sig_key", "id", "place", "allowed", "x", "y"])


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How much of its open parts a signature's lines share in front and behind; none where another signature has them."""
    for b in batches:
        out = []
        for key, place, *v in zip(*(c.to_pylist() for c in b.columns)):
            (h, t), (h2, t2) = _ends(*v[:5]), _ends(*v[6:11])
            p, q, *_ = _place(place)
            if v[5] > h + t and (p == q or v[11] > h2 + t2):
                out.append((key, h, t, h2, t2))
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)] if out else
                                         [pa.array([], pa.int64())] * 5, names=["cut_key", "h", "t", "h2", "t2"])


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Variants of short open parts as hashes."""
    import xxhash

    def rows(v, probe, own):
        return pa.RecordBatch.from_arrays([pa.array(np.array(v, np.uint64).view(np.int64)), pa.array(probe, pa.int32()),
                                           pa.array(own, pa.int64())], names=["v", "probe", "id"])

    for b in batches:
        v, probe, own = [], [], []
        for key, i, place, allowed, x, y in zip(*(c.to_pylist() for c in b.columns[:6])):
            for u in variants(x, y, place, allowed):
                v.append(xxhash.xxh64_intdigest(f"{key}|{u}"))
                probe.append(place & 1)
                own.append(i)
            if len(v) >= 200_000:
                yield rows(v, probe, own)
                v, probe, own = [], [], []
        yield rows(v, probe, own)


def _hang(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each line of a variant on its first indexed line; rows arrive sorted."""
    last, centre = None, None  # the run that goes on: its variant and its first indexed line
    for b in batches:
        if not b.num_rows:
            continue
        v, probe, ids = (c.to_numpy(zero_copy_only=False) for c in b.columns)
        new = np.r_[last is None or v[0] != last, v[1:] != v[:-1]]
        starts = np.flatnonzero(new)
        run = np.cumsum(new)  # 0: still the run before
        to = np.r_[0 if centre is None else centre, ids[starts]]
        has = np.r_[centre is not None, probe[starts] == 0]
        ok = has[run] & (to[run] != ids)
        last, centre = v[-1], (to[-1] if has[-1] else None)
        yield pa.RecordBatch.from_arrays([pa.array(to[run][ok]), pa.array(ids[ok])], names=["i", "j"])


def _split_again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The finer signatures of long open parts, some HELD code points at a time."""
    def out(rows):
        key, ids, place, allowed, xs, ys = (list(c) for c in zip(*rows))
        to, who, new, side = _finer(xs, ys, place, allowed, np.array(key, np.int64).view(np.uint64))
        columns = [np.array(key, np.int64)[who], np.array(ids, np.int64)[who], np.array(place, np.int64)[who], to, new, side]
        for s in range(0, len(to), 500_000):
            yield pa.RecordBatch.from_arrays([pa.array(c[s:s + 500_000]) for c in columns],
                                             names=["own_key", "own_id", "own_place", "sig_key", "new", "side"])

    rows, held = [], 0
    for b in batches:
        for row in zip(*b.columns[:6]):
            rows.append(tuple(c.as_py() for c in row))
            held += len(rows[-1][4]) + len(rows[-1][5]) + 100
            if held >= HELD:
                yield from out(rows)
                rows, held = [], 0
    if rows:
        yield from out(rows)


def _reopened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The open parts of a finer round: rows sig_key, id, place, new, side, allowed, x, y."""
    for b in batches:
        parts = [_finer_parts(x.as_py(), y.as_py(), *n) for *n, x, y in zip(
            *(b.column(i).to_pylist() for i in (2, 3, 4)), b.column(6), b.column(7))]
        yield pa.RecordBatch.from_arrays(
            [b.column(0), b.column(1), b.column(3), b.column(5), pa.array([x for x, _ in parts], pa.string()),
             pa.array([y for _, y in parts], pa.string())], names=["sig_key", "id", "place", "allowed", "x", "y"])


def _checked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs (a, b, line_a, line_b) within the allowed edits, some HELD code points at a time."""
    for b in batches:
        ok, todo, held = [], [], 0
        for x, y in zip(b.column(2), b.column(3)):
            x, y = _codes(x.as_py()), _codes(y.as_py())
            todo.append((x, y, int(edits_allowed(min(len(x), len(y))))))
            held += len(x) + len(y)
            if held >= HELD:
                ok += within_edits(todo).tolist()
                todo, held = [], 0
        ok += within_edits(todo).tolist()
        yield pa.RecordBatch.from_arrays([c.filter(pa.array(ok, pa.bool_())) for c in b.columns[:2]], names=["a", "b"])


def _hung_links(places: DataFrame, texts: DataFrame) -> DataFrame:
    """Links (a, b) of line keys under signatures with many lines, without pairs of all of them.

    A round cuts off what all lines of a signature share at the ends of their
    open parts (minima and maxima, combined map-side).  Short parts give
    variants, dealt out by signature and variant.  Long parts give finer
    signatures; those that few lines share end as candidate sets, the others
    make the next round, on parts of a third at most.  Texts move only for
    signatures that many lines share.
    """
    open_ = written(places.join(texts, F.col("id") == F.col("lid")).select("sig_key", "id", "place", "line")
                    .mapInArrow(_opened, _OPEN), "line-parts")
    hung, small = [], []
    while True:
        ends = open_.groupBy("sig_key").agg(F.first("place").alias("place"), *[
            f(e).alias(f"{c}{i}") for c in "xy" for i, (f, e) in enumerate([
                (F.min, F.col(c)), (F.max, F.col(c)), (F.min, F.reverse(c)), (F.max, F.reverse(c)),
                (F.min, F.length(c)), (F.max, F.length(c))])])
        cut = ends.mapInArrow(_cut, "cut_key long, h long, t long, h2 long, t2 long")
        long = F.expr(
            f"length(x) - if(place div {32 * FINE} = place div 32 % {FINE}, place % 32 div 8, place % 8 div 2 - 1) > {SHORT}"
            f" or place div {32 * FINE} <> place div 32 % {FINE}"
            f" and length(y) - (place % 32 div 8 - (place % 8 div 2 - 1)) > {SHORT}")
        parts = written(open_.join(cut, F.col("sig_key") == F.col("cut_key")).select(
            "sig_key", "id", "place", "allowed", F.expr("substring(x, cast(h + 1 as int), cast(length(x) - h - t as int))").alias("x"),
            F.expr("substring(y, cast(h2 + 1 as int), cast(length(y) - h2 - t2 as int))").alias("y")).withColumn("long", long),
            "line-parts")
        hung.append(parts.where("not long").mapInArrow(_keyed, "v long, probe int, id long")
                    .repartition("v").sortWithinPartitions("v", "probe", "id").mapInArrow(_hang, "i long, j long"))
        more = parts.where("long")
        if more.isEmpty():
            break
        finer = written(more.mapInArrow(
            _split_again, "own_key long, own_id long, own_place long, sig_key long, new long, side long"), "line-finer")
        groups = (finer.groupBy(F.col("sig_key").alias("to")).agg(F.count(F.lit(1)).alias("rows"), F.min(F.col("new") % 2).alias("p"))
                  .where("rows > 1 and p = 0").select("to", _crowded(key="to").alias("crowded")))
        kept = written(finer.join(groups, F.col("sig_key") == F.col("to")), "line-finer")
        small.append(kept.where("not crowded").select(
            F.expr("shiftleft(sig_key, 1) | (new & 1)").alias("sig"), F.col("own_id").alias("id")))
        open_ = written(kept.where("crowded").join(more, (F.col("own_key") == more["sig_key"]) & (F.col("own_id") == more["id"])
                                                   & (F.col("own_place") == more["place"]))
                        .select(kept["sig_key"], "id", "place", "new", "side", "allowed", "x", "y")
                        .mapInArrow(_reopened, _OPEN), "line-parts")
    pairs = hung[0]
    for more in hung[1:]:
        pairs = pairs.union(more)
    pairs = pairs.select(F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j")).distinct()
    left, right = (texts.select(F.col("lid").alias(f"lid_{c}"), F.col("key").alias(c), F.col("line").alias(f"line_{c}"))
                   for c in "ab")
    links = (pairs.join(left, F.col("i") == F.col("lid_a")).join(right, F.col("j") == F.col("lid_b"))
             .select("a", "b", "line_a", "line_b").mapInArrow(_checked, "a string, b string"))
    for sigs in small:
        sets = cut_lineage(candidate_sets(sigs))
        links = links.union(_verified(sets.join(texts, F.col("id") == F.col("lid")), True))
    return links


def similar_lines(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Components of distinct lines within the allowed edits: ``node``, ``root`` (line keys)."""
    sets = cut_lineage(candidate_sets(signatures(docs.select(text_col), "coarse", True)))
    members = _with_text(sets, docs, text_col)
    links = _verified(members.where(F.col("n") <= GIANT), False)
    giant = sets.where(F.col("n") > GIANT)
    if not giant.isEmpty():
        lines = cut_lineage(_with_text(giant, docs, text_col).dropDuplicates(["key"]))
        places = cut_lineage(signatures(lines.select("line"), "fine", False).withColumn(
            "sig_key", F.shiftrightunsigned("sig", 1)))
        hot = cut_lineage(places.groupBy("sig_key").agg(F.count(F.lit(1)).alias("rows")).where(_crowded())
                          .select("sig_key"))
        texts = lines.select(F.col("id").alias("lid"), "key", "line")
        again = cut_lineage(candidate_sets(places.join(hot, "sig_key", "left_anti").select("sig", "id")))
        links = links.union(_verified(again.join(texts, F.col("id") == F.col("lid")), True))
        if not hot.isEmpty():
            links = links.union(_hung_links(places.join(hot, "sig_key").select("sig_key", "id", "place"), texts))
    return connected_components(links)


def decide(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Lines to remove: doc_id, digest (of the text), n_lines, dropped (line numbers from 0, sorted), n_near.

    ``n_near`` of the dropped lines are not equal to any earlier line, only
    alike.  One row for each distinct (doc_id, text).
    """
    lines = F.transform(F.split(F.coalesce(F.col(text_col), F.lit("")), "\n"),
                        lambda x: F.when(F.btrim(x, F.lit(SPACES)) != "", _key(x)))
    m = written(docs.select(F.col(id_col).cast("long").alias("doc_id"),
                            F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("digest"),
                            lines.alias("lines")).distinct(), "lines")
    occ = (m.select("doc_id", "digest", F.posexplode("lines").alias("line_no", "key")).where("key is not null"))
    first = F.min(F.struct("doc_id", "line_no", "digest")).alias("first")
    by_class = occ.groupBy("key").agg(first, F.count(F.lit(1)).alias("n"))
    near = similar_lines(docs, text_col)
    classes = written(by_class.join(near, F.col("key") == F.col("node"), "left")
                      .where("n > 1 or node is not null").select("key", "first", "root"), "line-classes")
    best = classes.where("root is not null").groupBy("root").agg(F.min("first").alias("best"))
    keep = classes.join(best, "root", "left").select(
        F.col("key").alias("tl_key"), F.coalesce("best", "first").alias("best"), F.col("first").alias("own"))
    here = F.struct("doc_id", "line_no", "digest")
    gone = (occ.join(keep, F.col("key") == F.col("tl_key")).where(~here.eqNullSafe(F.col("best")))
            .withColumn("near", here.eqNullSafe(F.col("own")).cast("long")))
    lost = gone.groupBy(F.col("doc_id").alias("tl_id"), F.col("digest").alias("tl_digest")).agg(
        F.sort_array(F.collect_list("line_no")).alias("dropped"), F.sum("near").alias("n_near"))
    return (m.join(lost, F.col("doc_id").eqNullSafe(F.col("tl_id")) & (F.col("digest") == F.col("tl_digest")), "left")
            .select("doc_id", "digest", F.size("lines").cast("long").alias("n_lines"),
                    F.coalesce("dropped", F.array().cast("array<int>")).alias("dropped"),
                    F.coalesce("n_near", F.lit(0)).alias("n_near")))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents without repeated and nearly repeated lines; all rows and columns stay.

    Of lines that are equal or linked, the first one stays (smallest doc_id,
    null first, then line).  Lines without a word stay; lines under ten code
    points are compared for equality only.  A null text stays null; a text all
    of whose lines go becomes empty; repeated rows (same doc_id and text) are
    one document and change alike.  ``n_chars``, where present, follows.
    """
    d = decide(docs, id_col, text_col).where(F.size("dropped") > 0).select(
        F.col("doc_id").alias("tl_id"), F.col("digest").alias("tl_digest"), F.col("dropped").alias("tl_dropped"))
    t = F.col(text_col)
    out = (docs.withColumn("tl_d", F.xxhash64(F.coalesce(t, F.lit(""))))
           .join(d, F.col(id_col).cast("long").eqNullSafe(F.col("tl_id")) & (F.col("tl_d") == F.col("tl_digest")), "left"))
    left = F.array_join(F.filter(F.split(t, "\n"), lambda x, i: ~F.array_contains(F.col("tl_dropped"), i)), "\n")
    out = out.withColumn(text_col, F.when(F.col("tl_dropped").isNull(), t).otherwise(left))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("tl_dropped").isNull(), F.col("n_chars")).otherwise(
            F.length(text_col)).cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)
