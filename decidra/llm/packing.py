"""Best-fit packing by bin completion.

Documents become token ids plus an end id; only those over the capacity are cut, into full pieces behind a shorter first
one. What to put together depends on lengths alone, so the pieces are counted by length (one row per length, at most
`capacity` of them), and the plan is made on these counts. The best-fit plan of all pieces is the incumbent. Around the
largest piece left, undominated fillings of the room are enumerated from large to small, with the best-fit filling as
incumbent and its waste as bound; a filling is used for as many sequences as its counts allow at once. The last pieces,
where waste arises, get a branch and bound over sequences, and more of them where the plan does not meet the lower bound;
then a fractional plan (column generation over fillings) gives a better bound, and rounded and completed another plan. Pieces
are then numbered within their length (running(): a common length is numbered by many tasks), and a piece's number tells its
sequence and place, without any shuffle of ids.

A null text is empty: only the end id. Rows that share a doc_id are packed like different documents. Columns beyond
doc_id and text are ignored; no documents give no rows. Equal lengths are
interchangeable, and very long texts are cut; neither changes the number of sequences.
"""

from __future__ import annotations

import sys
import zlib
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from decidra.llm.common import cut, lean, plain_text, running, slices, small_batches, spread, table
from decidra.llm.tokens import END, TEXT_BYTES, ids

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PLACED = PIECES + ", sequence_id long, offset long"


def filling(room: int, left: dict[int, int], lengths: list[int], nodes: int = 2000, keep: int = 1) -> list[tuple[int, tuple[int, ...]]]:
    """Undominated fillings of room from `left` (length: count), by waste: the `keep` best found in so many nodes.

    lengths: those of `left`, ascending. The first filling is the best-fit one (always the largest that fits), and the
    incumbent. A branch is cut where all smaller pieces together could not waste less than the worst filling kept, and a
    filling is dominated, and dropped, if a piece in it could give way to a longer one within its waste."""
    found: list[tuple[int, tuple[int, ...]]] = []
    budget, used = nodes, Counter()
    upto = [0]
    for x in lengths:
        upto.append(upto[-1] + x * left[x])

    def dominated(waste: int, chosen: tuple[int, ...]) -> bool:
        for x in set(chosen):
            i = bisect_right(lengths, x)
            while i < len(lengths) and lengths[i] - x <= waste:
                if used[lengths[i]] < left[lengths[i]]:
                    return True
                i += 1
        return False

    def enter(room: int, below: int, chosen: tuple[int, ...]) -> bool:
        """Whether the search is over."""
        nonlocal budget
        i = bisect_right(lengths, min(room, below)) - 1
        leaf = True
        while i >= 0:
            x = lengths[i]
            if used[x] < left[x]:
                if not leaf and len(found) == keep and room - upto[i + 1] >= found[-1][0]:
                    break
                leaf = False
                budget -= 1
                used[x] += 1
                over = enter(room - x, x, (*chosen, x))
                used[x] -= 1
                if over:
                    return True
            i -= 1
        if leaf and (not found or not dominated(room, chosen)):
            found.append((room, chosen))
            found.sort()
            del found[keep:]
        return budget <= 0 or keep == 1 and found[0][0] == 0

    # one level for each piece of a filling
    sys.setrecursionlimit(max(sys.getrecursionlimit(), room + 1000))
    enter(room, room, ())
    return found


def least(left: dict[int, int], capacity: int) -> int:
    """No fewer sequences than this can hold them: by sum, and by pieces that exclude one another."""
    total = sum(x * n for x, n in left.items())
    return max(-(-total // capacity), sum(n for x, n in left.items() if 2 * x > capacity))


def lower_bound(counts: dict[int, int], capacity: int, most: int = 100) -> int:
    """least(), raised by two arguments that hold for every packing.

    For each e: pieces above capacity - e stand apart from all of e or more, those above half of the capacity from one
    another, and what pieces of e or more hold beyond the room beside them needs sequences of its own. For each k up to
    `most`: with x counted as floor((k + 1) x / capacity) / k sequences (as x / capacity, where that division is even), no
    sequence counts for more than one."""
    best = least(counts, capacity)
    upto, total, number = [0] * (capacity + 1), [0] * (capacity + 1), 0
    for x in range(1, capacity + 1):
        number += counts.get(x, 0)
        upto[x], total[x] = number, total[x - 1] + x * counts.get(x, 0)
    half = capacity // 2
    for e in range(1, half + 1):
        beside = upto[capacity - e] - upto[half]
        room = beside * capacity - (total[capacity - e] - total[half])
        best = max(best, number - upto[half] + max(0, -(-(total[half] - total[e - 1] - room) // capacity)))
    for k in range(2, most + 1):
        shares = sum(n * (k * x if (k + 1) * x % capacity == 0 else capacity * ((k + 1) * x // capacity)) for x, n in counts.items())
        best = max(best, -(-shares // (k * capacity)))
    return best


def complete(left: dict[int, int], capacity: int, nodes: int) -> list[tuple[int, ...]]:
    """Branch and bound over sequences: each takes the largest piece left and one of its best fillings."""
    bound = least(left, capacity)
    best: list[tuple[int, ...]] | None = None
    budget = nodes

    def enter(left: dict[int, int], done: list[tuple[int, ...]]) -> bool:
        nonlocal best, budget
        if not left:
            if best is None or len(done) < len(best):
                best = list(done)
            return len(best) == bound
        if best is not None and len(done) + least(left, capacity) >= len(best):
            return False
        top = max(left)
        rest = _less(left, {top: 1})
        for _, chosen in filling(capacity - top, rest, sorted(rest), nodes=300, keep=4):
            budget -= 1
            if enter(_less(rest, Counter(chosen)), [*done, (top, *chosen)]):
                return True
            if budget <= 0:
                return False
        return False

    enter(dict(left), [])
    return best or []


def _less(left: dict[int, int], used: dict[int, int]) -> dict[int, int]:
    return {x: m for x, n in left.items() if (m := n - used.get(x, 0))}


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """The best-fit plan: pieces from long to short, each to the fullest sequence that has room. Equal sequences are filled
    together, so its cost depends on the lengths and not on the number of pieces."""
    rooms: dict[int, list[tuple[tuple[int, ...], int]]] = {}

    def keep(room: int, chosen: tuple[int, ...], times: int) -> None:
        if times:
            rooms.setdefault(room, []).append((chosen, times))

    for x in sorted(counts, reverse=True):
        n, fits = counts[x], sorted(r for r in rooms if r >= x)
        for r in [*fits, capacity]:
            own = rooms.pop(r) if r in rooms else []
            while n and (own or r == capacity):
                # a piece makes its sequence the fullest one, so equal pieces fill it before the next
                chosen, times = own.pop() if own else ((), -(-n // (r // x)))
                each = min(r // x, n)
                full = min(times, n // each)
                keep(r - each * x, chosen + (x,) * each, full)
                n -= full * each
                rest = times - full
                if rest and n:
                    keep(r - n * x, chosen + (x,) * n, 1)
                    rest, n = rest - 1, 0
                if chosen and rest:
                    own.append((chosen, rest))
            for chosen, times in own:
                keep(r, chosen, times)
    return [x for own in rooms.values() for x in own]


def relaxed(counts: dict[int, int], capacity: int, columns: int = 1000) -> tuple[int, list[tuple[tuple[int, ...], float]]]:
    """A lower bound on sequences, and fillings with the fractional number of sequences of each: the linear relaxation of packing,
    by column generation. The best new filling for the prices of the lengths comes from a table over rooms.

    After `columns` fillings the search stops; the bound (prices, over the best filling's price) holds at any point."""
    lengths = np.array(sorted(x for x, n in counts.items() if n), np.int64)
    need = np.array([counts[x] for x in lengths.tolist()], float)
    m = len(lengths)
    fill = [np.eye(m, dtype=np.int64)[k] * (capacity // x) for k, x in enumerate(lengths.tolist())]
    inverse = np.diag(1.0 / (capacity // lengths))
    amount, bound = inverse @ need, 0.0
    fits = np.searchsorted(lengths, np.arange(capacity + 1), "right")
    for _ in range(columns):
        price = inverse.sum(0)
        worth, pick = np.zeros(capacity + 1), np.full(capacity + 1, -1)
        for room in range(1, capacity + 1):
            worth[room] = worth[room - 1]
            if k := fits[room]:
                own = worth[room - lengths[:k]] + price[:k]
                best = own.argmax()
                if own[best] > worth[room]:
                    worth[room], pick[room] = own[best], best
        bound = max(bound, price @ need / max(1.0, worth[capacity]))
        if worth[capacity] <= 1 + 1e-9:
            break
        new, room = np.zeros(m, np.int64), capacity
        while room:
            if pick[room] >= 0:
                new[pick[room]] += 1
                room -= lengths[pick[room]]
            else:
                room -= 1
        step = inverse @ new
        ratio = np.where(step > 1e-9, amount / np.maximum(step, 1e-9), np.inf)
        leave = int(ratio.argmin())
        inverse[leave] /= step[leave]
        others = np.arange(m) != leave
        inverse[others] -= np.outer(step[others], inverse[leave])
        fill[leave], amount = new, np.maximum(inverse @ need, 0)
    return int(np.ceil(bound - 1e-6)), [(tuple(np.repeat(lengths, f)[::-1].tolist()), float(a)) for f, a in zip(fill, amount, strict=True)]


def coarse(counts: dict[int, int], capacity: int, up: bool, steps: int = 256) -> tuple[dict[int, int], int, int]:
    """(numbers of pieces by length in steps, capacity in steps, length of a step). Lengths rounded up give fillings that hold for
    the pieces; rounded down, a bound that holds for them."""
    step = max(1, capacity // steps)
    out: Counter[int] = Counter()
    for x, n in counts.items():
        out[-(-x // step) if up else x // step] += n
    del out[0]
    return dict(out), capacity // step, step


def rounded(counts: dict[int, int], capacity: int, nodes: int) -> list[tuple[tuple[int, ...], int]]:
    """A plan from a fractional one: each of its fillings as often as it goes into its number, with the pieces of its lengths
    in turn, what is left by the better of completion and best fit."""
    own, room, step = coarse(counts, capacity, up=True)
    runs: dict[int, list[list[int]]] = {}
    for x in sorted(counts):
        runs.setdefault(-(-x // step), []).append([x, counts[x]])
    plan = []
    for kind, amount in relaxed(own, room)[1]:
        need = Counter(kind)
        times = min([int(amount + 1e-6), *(own[x] // k for x, k in need.items())])
        for x, k in need.items():
            own[x] -= k * times
        while times:
            chosen, each = [], times
            for x, k in need.items():
                # k pieces of the longest run that is left; a run with fewer gives them to one sequence, with the next run's
                if runs[x][-1][1] >= k:
                    chosen += [runs[x][-1][0]] * k
                    each = min(each, runs[x][-1][1] // k)
                else:
                    each = 1
                    at = len(runs[x])
                    while k:
                        at -= 1
                        chosen += [runs[x][at][0]] * min(k, runs[x][at][1])
                        k -= min(k, runs[x][at][1])
            for x in need:
                for length, k in Counter(c for c in chosen if -(-c // step) == x).items():
                    run = next(r for r in reversed(runs[x]) if r[0] == length)
                    run[1] -= k * each
                while runs[x] and not runs[x][-1][1]:
                    runs[x].pop()
            plan.append((tuple(sorted(chosen, reverse=True)), each))
            times -= each
    rest = {x: n for own in runs.values() for x, n in own if n}
    return plan + min(_plan(rest, capacity, 60, nodes), best_fit(rest, capacity), key=_sequences) if rest else plan


def pack_counts(counts: dict[int, int], capacity: int, tail: int = 60, nodes: int = 3000) -> list[tuple[tuple[int, ...], int]]:
    """(lengths in a sequence, number of such sequences) for these numbers of pieces by length.

    The best-fit plan of all pieces is the first incumbent, so no result needs more sequences. Then one completion at a time until
    `tail` pieces are left, which get the branch and bound over sequences. A plan that meets lower_bound() is known to need
    the fewest sequences. Where it does not, the fractional plan of relaxed() is rounded and completed, and its bound counts,
    too; then four times as many pieces are left to the search, until that is all of them or it has found nothing better twice; no
    plan could save more than the sequences beyond the bound."""
    if any(not 0 < x <= capacity for x in counts):
        raise ValueError("a piece must have 1 to capacity tokens")
    bound, pieces, first = lower_bound(counts, capacity), sum(counts.values()), tail
    best = best_fit(counts, capacity)
    if _sequences(best) == bound:
        return best
    completed, idle = None, 0
    while True:
        plan = _plan(counts, capacity, tail, nodes)
        completed, idle = (plan, 0) if completed is None or _sequences(plan) < _sequences(completed) else (completed, idle + 1)
        if tail == first and min(map(_sequences, (best, plan))) > bound:
            bound = max(bound, relaxed(*coarse(counts, capacity, up=False)[:2])[0])
            best = min(best, rounded(counts, capacity, nodes), key=_sequences)
        best = min(best, completed, key=_sequences)
        if _sequences(best) == bound or tail >= pieces or idle == 2:
            return best
        tail *= 4


def _sequences(plan: list[tuple[tuple[int, ...], int]]) -> int:
    return sum(times for _, times in plan)


def _plan(counts: dict[int, int], capacity: int, tail: int, nodes: int) -> list[tuple[tuple[int, ...], int]]:
    left = {x: n for x, n in counts.items() if n}
    lengths, pieces = sorted(left), sum(left.values())
    plan: list[tuple[tuple[int, ...], int]] = []
    while pieces > tail:
        top = lengths[-1]
        left[top] -= 1
        chosen = filling(capacity - top, left, lengths)[0][1] if top < capacity else ()
        left[top] += 1
        need = Counter((top, *chosen))
        times = min(left[x] // k for x, k in need.items())
        # what is over stays for the search
        times = min(times, -(-(pieces - tail) // len((top, *chosen))))
        plan.append(((top, *chosen), times))
        for x, k in need.items():
            left[x] -= k * times
            pieces -= k * times
            if not left[x]:
                del left[x]
                lengths.pop(bisect_right(lengths, x) - 1)
    return plan + [(chosen, 1) for chosen in complete(left, capacity, nodes)] if left else plan


def slots(plan: list[tuple[tuple[int, ...], int]]) -> np.ndarray:
    """Rows of length, first number, pieces side by side, first sequence, offset: pieces of a length, by their number."""
    rows, given, sequence = [], Counter(), 0
    for chosen, times in plan:
        at = 0
        for x, k in sorted(Counter(chosen).items(), reverse=True):
            rows.append((x, given[x], k, sequence, at))
            given[x] += k * times
            at += k * x
        sequence += times
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def token_pieces(docs: DataFrame, capacity: int = 2048, vocabulary: str | None = None) -> DataFrame:
    """The pieces of every row of docs: doc_id, piece, start, length, ids_crc32."""
    small_batches(docs.sparkSession, 2 * TEXT_BYTES)

    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = ids(vocabulary)
        for batch in slices(batches, most=TEXT_BYTES):
            flat, bounds = bpe.encode(batch["text"])
            out: list[list] = [[], [], [], [], []]
            for doc, a, b in zip(batch["doc_id"].to_pylist(), bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                own = np.append(flat[a:b], np.uint32(END)).astype("<u4")
                start, piece = 0, 0
                while start < len(own):
                    end = min(len(own), start + ((len(own) - start - 1) % capacity + 1 if piece == 0 else capacity))
                    for column, x in zip(out, (doc, piece, start, end - start, zlib.crc32(own[start:end].tobytes())), strict=True):
                        column.append(x)
                    start, piece = end, piece + 1
            yield pa.record_batch([pa.array(c, pa.int32() if i == 1 else pa.int64()) for i, c in enumerate(out)], names=["doc_id", "piece", "start", "length", "ids_crc32"])
        bpe.forget()

    return docs.select(F.col("doc_id").cast("long"), plain_text().alias("text")).mapInArrow(lean(cut_up), PIECES)


def pack(pieces: DataFrame, capacity: int = 2048) -> DataFrame:
    """Adds sequence_id and offset to pieces that have a `length` (and doc_id and piece, for an even spread).

    The driver sees one row per length, `capacity` of them at most."""
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    table_of = slots(pack_counts(counts, capacity))
    key = (table_of[:, 0] << 44) + table_of[:, 1] if len(table_of) else np.zeros(0, np.int64)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, number = batch["length"].to_numpy(), batch["_number"].to_numpy()
            found = table_of[np.searchsorted(key, (length << 44) + number, side="right") - 1]
            step = number - found[:, 1]
            added = {"sequence_id": found[:, 3] + step // found[:, 2], "offset": found[:, 4] + step % found[:, 2] * length}
            yield pa.record_batch({n: batch[n] for n in ("doc_id", "piece", "start", "length", "ids_crc32")} | {k: pa.array(v) for k, v in added.items()})

    return running(pieces, ["length"], spread("doc_id", "piece"), name="_number").mapInArrow(place, PLACED)


def pack_documents(docs: DataFrame, capacity: int = 2048, vocabulary: str | None = None) -> DataFrame:
    return pack(cut(token_pieces(docs, capacity, vocabulary), "op9-pieces"), capacity)


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))
