"""Packing of integer lengths into bins of one capacity: best fit decreasing, and bin completion."""

from __future__ import annotations

import random
from collections import defaultdict
from collections.abc import Iterator, Sequence


class CapacityTree:
    """Segment tree over residual capacities; finds the least residual that is at least a given length.

    Leaf r counts the open bins with r tokens of room; an inner node holds the sum of its leaves.
    """

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.count = [0] * (2 * self.size)

    def add(self, room: int, by: int) -> None:
        at = self.size + room
        while at:
            self.count[at] += by
            at >>= 1

    def least(self, length: int) -> int | None:
        """The smallest occupied leaf at or right of length."""
        at = self.size + length
        if self.count[at]:
            return length
        while at > 1:
            if not at & 1 and self.count[at + 1]:  # the right sibling holds larger rooms
                at += 1
                while at < self.size:
                    at = 2 * at if self.count[2 * at] else 2 * at + 1
                return at - self.size
            at >>= 1
        return None


def best_fit_decreasing(lengths: Sequence[int], capacity: int) -> list[list[int]]:
    """Bins of indices into lengths: longest first, each into the open bin that it leaves with the least room.

    Ties go to the earlier index. Lengths are 1 to capacity.
    """
    tree, rooms, bins = CapacityTree(capacity), defaultdict(list), []
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        n = lengths[i]
        room = tree.least(n)
        if room is None:
            own, room = len(bins), capacity
            bins.append([])
        else:
            own = rooms[room].pop()
            tree.add(room, -1)
        bins[own].append(i)
        if room > n:
            rooms[room - n].append(own)
            tree.add(room - n, 1)
    return bins


def lower_bound(lengths: Sequence[int], capacity: int) -> int:
    """Martello and Toth's L2: total length, strengthened by the items that exclude each other."""
    counts = [0] * (capacity + 1)
    for n in lengths:
        counts[n] += 1
    over, total_over = [0] * (capacity + 2), [0] * (capacity + 2)  # items of at least this length
    for n in range(capacity, -1, -1):
        over[n], total_over[n] = over[n + 1] + counts[n], total_over[n + 1] + n * counts[n]
    best, half = -(-total_over[0] // capacity), capacity // 2 + 1
    for k in {0} | {n for n in range(1, capacity // 2 + 1) if counts[n]}:
        large = over[capacity - k + 1] if k else 0  # those leave no room for an item of length k
        top = capacity - k + 1 if k else capacity + 1
        middle, middle_total = over[half] - over[top], total_over[half] - total_over[top]
        small_total = total_over[k] - total_over[half]
        best = max(best, large + middle + max(0, -(-(small_total - (middle * capacity - middle_total)) // capacity)))
    return best


def _completions(room: int, mask: int, counts: list[int], slack: int, width: int, long_first: bool) -> tuple[list[tuple[int, tuple[int, ...]]], int]:
    """(waste, lengths) of undominated fillings of room with any number of items, least waste first, and among these those with the longest (or shortest) items.

    mask has bit n set if a length n is left, counts says how often. The search goes over distinct lengths, longest
    first, and drops what can't waste `slack` or less. A filling is dominated if one other item, or one longer item in
    the place of one of its own, fits as well. It ends with `width` fillings without waste, or `4 * width` in all. Where a quick
    search doesn't get there, sums that the shorter lengths can reach guide it, so that no step leads nowhere. Also how many steps it took.
    """
    found: list[tuple[int, tuple[int, ...]]] = []
    least, steps, exact = (mask & -mask).bit_length() - 1, 20 * width, 0
    own: list[tuple[int, int]] = []  # length and how often
    reach: dict[int, int] | None = None  # by length: the sums that it and the shorter ones can reach, as bits

    def largest(limit: int) -> int:
        return (mask & ((1 << (limit + 1)) - 1)).bit_length() - 1 if limit > 0 else 0

    def reachable() -> dict[int, int]:
        out, sums, whole = {}, 1, (1 << (room + 1)) - 1
        lengths = mask & whole
        while lengths:
            n = (lengths & -lengths).bit_length() - 1
            lengths &= lengths - 1
            k, some = min(counts[n], room // n), 1
            while k:  # counts in binary parts
                part = min(some, k)
                sums |= (sums << (part * n)) & whole
                k, some = k - part, 2 * some
            out[n] = sums
        return out

    def dominated(left: int) -> bool:
        used = dict(own)
        for n in (0, *used):  # 0: one more item
            longer = (mask & ((1 << (n + left + 1)) - 1)) >> (n + 1)
            while longer:
                x = n + (longer & -longer).bit_length()
                if counts[x] > used.get(x, 0):
                    return True
                longer &= longer - 1
        return False

    def ended() -> bool:
        return steps <= 0 or exact >= width or len(found) >= 4 * width

    def fill(left: int, cap: int) -> None:
        nonlocal steps, exact
        steps -= 1
        if left <= slack and not (left and dominated(left)):
            found.append((left, tuple(n for n, k in own for _ in range(k))))
            exact += not left
            return  # whatever else fits would have shown it dominated
        need, n = left - slack, largest(min(left, cap))
        while n > 0 and not ended():
            if reach is not None and not (reach[n] >> max(0, need)) & ((1 << (left - max(0, need) + 1)) - 1):
                return
            items = max(1, -(-need // n))  # at least so many more
            most = left - (items - 1) * least
            if most < least:
                return
            if n > most:
                n = largest(most)
                continue
            for k in range(min(counts[n], left // n), 0, -1):
                own.append((n, k))
                fill(left - k * n, n - 1)
                own.pop()
                if ended():
                    return
            n = largest(n - 1)

    fill(room, room)
    took = 20 * width - steps
    if steps <= 0:
        found.clear()
        reach, steps, exact = reachable(), 200 * width, 0
        fill(room, room)
        took += 200 * width - steps + mask.bit_count()
    return sorted(set(found), key=lambda x: (x[0], [-n if long_first else n for n in x[1]]))[:width], took


def bin_completion(lengths: Sequence[int], capacity: int, nodes: int = 50_000, width: int = 40) -> list[list[int]]:
    """Bins of indices into lengths, as few as branch and bound finds.

    The incumbent begins as best fit decreasing. A search for a number of bins, the lower bound first, branches on
    the fillings around the longest item left; it goes back where the waste so far exceeds what that many bins can
    waste, or where the items left have failed before. Its solution becomes the incumbent; where it has none, so does its longest
    part with the rest packed by best fit decreasing, if that is less, and the next search is for half-way more bins. Each number is
    searched for twice, with fillings of long items first and of short ones. Searches end
    where they meet the incumbent, or when `nodes` are used up: the steps forth and back of all searches, and a fiftieth of the steps among fillings, so that
    they bound the time (about 20 µs each); `width` fillings are
    tried at a node. Any incumbent packs every item.
    """
    best = best_fit_decreasing(lengths, capacity)
    least, total = lower_bound(lengths, capacity), sum(lengths)
    by_length = defaultdict(list)
    for i, n in enumerate(lengths):
        by_length[n].append(i)
    left = nodes
    while len(best) > least and left > 0:
        for long_first in (True, False):
            budget = min(left, max(2 * len(best), left // 4))
            shape, unused, whole = _search(by_length, capacity, least * capacity - total, budget, width, long_first)
            left -= budget - unused
            pools = {n: iter(own) for n, own in by_length.items()}
            found = [[next(pools[n]) for n in own] for own in shape]
            if not whole:
                rest = sorted(i for own in pools.values() for i in own)
                found += [[rest[k] for k in own] for own in best_fit_decreasing([lengths[i] for i in rest], capacity)]
            best = min(best, found, key=len)
            if whole:
                break
        least += max(1, (len(best) - least) // 2)
    return best


def _search(by_length: dict[int, list[int]], capacity: int, allowed: int, nodes: int, width: int, long_first: bool) -> tuple[list[tuple[int, ...]], int, bool]:
    """A packing that wastes at most `allowed` tokens, as lengths by bin; the nodes left; and if it is whole, or else the longest part."""
    counts, mask = [0] * (capacity + 1), 0
    rng = random.Random(capacity)
    signs = {n: rng.getrandbits(64) for n in by_length}  # the sum of what is left tells states apart
    state = 0
    for n, own in by_length.items():
        counts[n] = len(own)
        mask |= 1 << n
        state += len(own) * signs[n]
    done: list[tuple[int, ...]] = []
    wasted, states = [0], [state]
    part: list[tuple[int, ...]] = []
    failed: dict[int, int] = {}  # what was left where a search failed, and the fewest bins it had used

    def choices() -> Iterator[tuple[int, tuple[int, ...]]]:
        nonlocal nodes
        top = mask.bit_length() - 1
        counts[top] -= 1
        now = mask if counts[top] else mask & ~(1 << top)
        found, took = _completions(capacity - top, now, counts, allowed - wasted[-1], width, long_first)
        counts[top] += 1
        nodes -= took // 50
        return iter([(waste, (top, *rest)) for waste, rest in found])

    if not mask:
        return [], nodes, True
    stack = [choices()]
    while stack and nodes > 0:
        nodes -= 1
        step = next(stack[-1], None)
        if step is None:
            stack.pop()
            state = states.pop()
            failed[state] = min(len(done), failed.get(state, len(done)))
            if len(done) > len(part):
                part = list(done)
            if done:
                for n in done.pop():
                    counts[n] += 1
                    mask |= 1 << n
                wasted.pop()
            continue
        waste, own = step
        state = states[-1] - sum(signs[n] for n in own)
        if failed.get(state, len(done) + 2) <= len(done) + 1:
            continue
        for n in own:
            counts[n] -= 1
            if not counts[n]:
                mask &= ~(1 << n)
        done.append(own)
        wasted.append(wasted[-1] + waste)
        states.append(state)
        if not mask:
            return done, nodes, True
        stack.append(choices())
    return max(part, done, key=len), nodes, False
