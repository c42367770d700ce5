"""The model of operator 11: bits of a token stream, predicted by mixed contexts.

A text becomes a stream of tokens: each word and one space after it, and a line feed at the end.
A byte is coded in the Huffman code of its class: of the byte before it, or of the two bytes before it
if these are one of the PAIRS most frequent (all counted over the corpus).  Each bit of the code is
predicted: every context (the class, the last four bytes of the token, the token so far, and, for its
first LEAD bytes, that with the token before it) has a slot of counts of zeros and ones, found by
hashing, and says log((n1 + PRIOR) / (n0 + PRIOR)).  Weights, chosen by a gate, mix these in the
logistic domain; after every bit they go down the gradient of its cost.  What is said of a bit is
kept as said for the value that it has, so that one and the same formula costs ones and zeros.  A lane is a run of LANE
bytes of one document; each starts from the fitted weights, so lanes are mixed side by side.

Any split of a stream into batches gives the same contexts and lanes: tokens longer than PIECE are
cut there, and what a token's bits see of the past are the token itself and the hash of the one
before.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np
import pandas as pd

SPACE, END = 32, 10
#: Bytes of a lane, and of a token's pieces.
LANE, PIECE = 256, 4096
#: Bytes of a token that the token before it helps to predict; then the token so far says which it is.
LEAD = 3
#: Bytes of the stream that are mixed at once, about.
BATCH = 1 << 20
#: Pairs of bytes that have a class of their own, beside the 256 single ones.
PAIRS = 256
CLASSES = 256 + PAIRS
#: Log2 of the slots of each context: a class has one for each node of its code, counted by its bytes.
BITS = (17, 22, 22, 22)
CONTEXTS = len(BITS)
STARTS = tuple(sum(1 << b for b in BITS[:k]) for k in range(CONTEXTS + 1))
#: Slots that are summed together.
CHUNK = 1 << 16
PRIOR = 0.4
#: Steps of a prediction (in nats) that its byte holds.
SCALE = 12
#: Gates: how sure the token so far is (unseen, seen little, seen much), and with the token before.
SURE = 2 * SCALE
GATES = 9
#: Of the refinement; steps of the fit, and how firmly equal weights are held.
RATE = 0.02
ROUNDS = 12
#: Of the cost: a step over all training documents that takes off no more of it is the last.
SETTLED = 1e-3
RIDGE = 1000.0
#: Bits of a lane that are fetched at once.
AHEAD = 32
#: Bits never cost more nats than this.
MOST = 12
_ODD = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_LOWER[9:14] = SPACE


def stream_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The token stream of texts, and its offsets."""
    n = len(offsets) - 1
    raw = np.insert(_LOWER[data], np.repeat(offsets[1:], 2), np.tile(np.array([SPACE, END], np.uint8), n))
    space = raw == SPACE
    before = np.ones(len(raw), bool)  # nothing, a space or another text's end stands before
    before[1:] = space[:-1] | (raw[:-1] == END)
    keep = ~(space & before)
    out = raw[keep]
    return out, np.r_[0, np.flatnonzero(out == END) + 1].astype(np.int64)


def tokens_of(stream: np.ndarray) -> np.ndarray:
    """Where tokens, and the pieces of long ones, begin; and the stream's length."""
    if not len(stream):
        return np.zeros(1, np.int64)
    first = np.flatnonzero(np.r_[True, stream[:-1] <= SPACE]) if stream.min() > 8 else np.flatnonzero(np.r_[True, (stream[:-1] == SPACE) | (stream[:-1] == END)])
    ends = np.r_[first[1:], len(stream)]
    pieces = -(-(ends - first) // PIECE)
    if pieces.max() > 1:
        first = np.repeat(first, pieces) + PIECE * (np.arange(int(pieces.sum())) - np.repeat(np.cumsum(pieces) - pieces, pieces))
    return np.r_[first, len(stream)]


def _before(stream: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The two bytes before each byte inside its token, the last in the lower half: a space before the
    first byte, and nothing before that."""
    out = np.empty(len(stream), np.uint16)
    out[1:] = stream[:-1]
    first = starts[:-1]
    out[first] = SPACE
    second = first[np.diff(starts) > 1] + 1
    out[2:] |= stream[:-2].astype(np.uint16) << 8
    out[first] = SPACE
    out[second] &= 0xFF
    return out


def pair_counts(stream: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """How often each two bytes stand before a byte."""
    return np.bincount(_before(stream, starts), minlength=65536)


def classes_of(pairs: np.ndarray) -> np.ndarray:
    """The class of each two bytes: the most frequent ones have their own, after those of single bytes."""
    out = (np.arange(65536) & 0xFF).astype(np.int32)
    most = np.argsort(-pairs, kind="stable")[:PAIRS]
    most = most[pairs[most] > 0]
    out[most] = 256 + np.arange(len(most))
    return out


def class_counts(stream: np.ndarray, starts: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """How often each byte follows each class."""
    return np.bincount(classes.take(_before(stream, starts)) << 8 | stream, minlength=CLASSES << 8)


class Code:
    """Huffman codes of a byte after each class: for each class and byte the length and place of its
    path, and along the paths the nodes (class and node) and bits."""

    def __init__(self, counts: np.ndarray, classes: np.ndarray):
        nodes, bits, length = [], [], np.zeros(CLASSES << 8, np.int64)
        for own in range(CLASSES):
            heap = [(int(c) * 256 + 1, s) for s, c in enumerate(counts[own * 256 : own * 256 + 256])]
            heapq.heapify(heap)
            parent = {}
            for node in range(255):
                a, b = heapq.heappop(heap), heapq.heappop(heap)
                parent[a[1]], parent[b[1]] = (node, 0), (node, 1)
                heapq.heappush(heap, (a[0] + b[0], 256 + node))
            for symbol in range(256):
                path, at = [], symbol
                while at in parent:
                    node, bit = parent[at]
                    path.append((own << 8 | node, bit))
                    at = 256 + node
                nodes += [p for p, _ in reversed(path)]
                bits += [b for _, b in reversed(path)]
                length[own << 8 | symbol] = len(path)
        self.classes, self.length, self.place = classes, length, np.cumsum(length) - length
        self.nodes, self.bits = np.array(nodes, np.uint32), np.array(bits, np.uint8)


_POWERS: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> list[np.ndarray]:
    """Powers of an odd number and of its inverse; kept, as every batch uses them."""
    if len(_POWERS[0]) < n:
        for k, factor in enumerate((_ODD, _BACK)):
            powers = np.full(n, factor, np.uint64)
            powers[0] = 1
            _POWERS[k] = np.cumprod(powers, dtype=np.uint64)
    return _POWERS


@dataclass
class Coded:
    """Tokens as bits: per bit its slots (contexts x bits, without the last context), node and value;
    per byte where its bits begin and the hash of its token so far; per token where its bytes begin
    and its hash."""

    slots: list[np.ndarray]
    node: np.ndarray
    bit: np.ndarray
    begin: np.ndarray
    so_far: np.ndarray
    bytes: np.ndarray
    hash: np.ndarray


def _slot(hashed: np.ndarray, node: np.ndarray, k: int) -> np.ndarray:
    x = node * np.uint32(0x9E3779B1)
    x += hashed
    x *= np.uint32(0x85EBCA6B)
    x ^= x >> np.uint32(15)
    x *= np.uint32(0xC2B2AE35)
    x >>= np.uint32(32 - BITS[k])
    x += np.uint32(STARTS[k])
    return x.view(np.int32)


def coded(stream: np.ndarray, first: np.ndarray, length: np.ndarray, code: Code) -> Coded:
    """The tokens that begin at ``first``, one after another."""
    begin = np.cumsum(length) - length
    total = int(length.sum())
    b = stream[np.repeat(first - begin, length) + np.arange(total)]
    inside = np.arange(total) - np.repeat(begin, length)
    last = np.zeros((4, total), np.uint32)  # the bytes before, as far as the token goes
    for k, x in enumerate(last, 1):
        np.multiply(b[:-k], inside[k:] >= k, out=x[k:])
    last[0][begin] = SPACE
    up, down = _powers(total + 1)
    sums = np.r_[np.uint64(0), np.cumsum((b.astype(np.uint64) + np.uint64(1)) * up[:total])]
    so_far = (sums[:-1] - np.repeat(sums[begin], length)) * np.repeat(down[begin], length)
    whole = (sums[begin + length] - sums[begin]) * down[begin]
    pair = code.classes.take(last[0] | last[1] << np.uint32(8)) << 8 | b
    bits = code.length[pair]
    ends = np.cumsum(bits)
    n = int(ends[-1]) if total else 0
    of = np.repeat(np.arange(total, dtype=np.int32), bits)
    path = (code.place[pair] - (ends - bits)).astype(np.int32).take(of)
    path += np.arange(n, dtype=np.int32)
    node = code.nodes.take(path)
    four = (last[0] | last[1] << np.uint32(8) | last[2] << np.uint32(16) | last[3] << np.uint32(24)) * np.uint32(0x2C1B3C6D)
    token = ((so_far * _ODD) >> np.uint64(32)).astype(np.uint32)
    slots = [node.astype(np.int32)] + [_slot(h.take(of), node, k) for k, h in enumerate((four, token), 1)]
    return Coded(slots, node, code.bits.take(path), np.r_[ends - bits, n], token, np.r_[begin, total], (whole * _ODD >> np.uint64(29)).astype(np.uint32))


@dataclass
class Batch:
    """A part of a stream: its distinct tokens as bits, and where each bit of the part stands there."""

    distinct: Coded
    times: np.ndarray  # of each distinct token
    row: np.ndarray | None
    bits: np.ndarray  # of each byte of the part
    pair: np.ndarray  # slots of the last context, of the bits that have it,
    pair_row: np.ndarray  # where those stand among the distinct ones
    pair_at: np.ndarray  # and in the part


def batch_of(stream: np.ndarray, starts: np.ndarray, at: int, to: int, code: Code, rows: bool = True) -> Batch:
    """The bytes from ``at`` up to ``to`` of a stream with the given tokens; ``rows``: with each bit's place."""
    a, z = int(np.searchsorted(starts, at, side="right")) - 1, int(np.searchsorted(starts, to))
    first, length = starts[a:z], np.diff(starts[a : z + 1])
    prior = 1 if a else 0  # the token before the first
    hashed = _token_hashes(stream, starts[a - prior : z + 1])
    # equal tokens by hash and length
    number, kinds = pd.factorize(hashed[prior:] ^ (length.astype(np.uint64) * _BACK))
    index = np.empty(len(kinds), np.int64)
    index[number[::-1]] = np.arange(len(number) - 1, -1, -1)
    d = coded(stream, first[index], length[index], code)
    before = np.r_[np.zeros(1 - prior, np.uint64), hashed[: len(first) - 1 + prior]]
    before[stream[first - 1] == END] = 0  # a text begins
    where = np.repeat(d.bytes[number] - first, length) + np.arange(int(first[0]), int(first[0]) + int(length.sum()))  # of each byte among the distinct
    cut = slice(at - int(first[0]), to - int(first[0]))
    where = where[cut]
    bits = d.begin[where + 1] - d.begin[where]
    ends = np.cumsum(bits)
    row = _runs(d.begin[where], bits) if rows else None
    inside = np.arange(len(where)) + at - np.repeat(first, length)[cut]
    lead = np.flatnonzero(inside < LEAD)
    mixed = np.repeat((before * _ODD >> np.uint64(31)).astype(np.uint32), length)[cut][lead] * np.uint32(0xCC9E2D51) + d.so_far[where[lead]]
    pair_row = _runs(d.begin[where[lead]], bits[lead])
    pair = _slot(np.repeat(mixed, bits[lead]), d.node.take(pair_row), CONTEXTS - 1)
    return Batch(d, np.bincount(number, minlength=len(kinds)), row, bits, pair, pair_row, _runs((ends - bits)[lead], bits[lead]))


def _runs(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Runs of ``n`` numbers from each start on, one after another."""
    ends = np.cumsum(n)
    out = np.repeat((start - (ends - n)).astype(np.int32), n)
    out += np.arange(len(out), dtype=np.int32)
    return out


def _token_hashes(stream: np.ndarray, starts: np.ndarray) -> np.ndarray:
    if len(starts) < 2:
        return np.zeros(0, np.uint64)
    a, z = int(starts[0]), int(starts[-1])
    up, down = _powers(z - a + 1)
    sums = np.r_[np.uint64(0), np.cumsum((stream[a:z].astype(np.uint64) + np.uint64(1)) * up[: z - a])]
    at = starts - a
    return (sums[at[1:]] - sums[at[:-1]]) * down[at[:-1]]


def cuts_of(docs: np.ndarray, size: int = BATCH) -> np.ndarray:
    """Where batches begin: at lanes, about ``size`` bytes apart; and the end."""
    lanes = lanes_of(docs)
    at = [0]
    while at[-1] < docs[-1]:
        to = int(np.searchsorted(lanes, at[-1] + size, side="right")) - 1
        at.append(int(max(lanes[to], lanes[np.searchsorted(lanes, at[-1], side="right")])))
    return np.array(at, np.int64)


def lanes_of(docs: np.ndarray) -> np.ndarray:
    """Where lanes begin in a stream with these document offsets; and its length."""
    length = np.diff(docs)
    n = -(-length // LANE)
    return np.r_[np.repeat(docs[:-1], n) + LANE * (np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)), docs[-1]]


def count_bits(table: np.ndarray, stream: np.ndarray, starts: np.ndarray, code: Code) -> None:
    """Add a stream's bits to ``table`` (slots x 2), but for those of the first context: each distinct
    token's once, by how often it stands there, and those of the last context one by one."""
    flat = table.reshape(-1)
    cuts = np.unique(np.append(np.searchsorted(starts[:-1], np.arange(0, len(stream), BATCH)), len(starts) - 1))
    for a, z in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
        batch = batch_of(stream, starts, int(starts[a]), int(starts[z]), code, rows=False)
        d = batch.distinct
        seen = np.repeat(batch.times.astype(table.dtype), np.diff(d.begin[d.bytes]))
        for slot in d.slots[1:]:
            np.add.at(flat, slot * 2 + d.bit, seen)
        np.add.at(flat, batch.pair * 2 + d.bit.take(batch.pair_row), table.dtype.type(1))


def node_counts(pairs: np.ndarray, code: Code) -> np.ndarray:
    """The first context's counts (slots x 2), by those of bytes after classes."""
    out = np.zeros((1 << BITS[0], 2), np.int64)
    used = np.flatnonzero(pairs)
    n = code.length[used]
    path = np.repeat(code.place[used] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
    np.add.at(out.reshape(-1), code.nodes[path].astype(np.int64) * 2 + code.bits[path], np.repeat(pairs[used], n))
    return out


def predictions(counts: np.ndarray) -> np.ndarray:
    """What slots (slots x 2) say, in steps of 1 / SCALE nats."""
    c = np.maximum(counts, 0)
    return np.clip(np.rint(SCALE * np.log((c[:, 1] + PRIOR) / (c[:, 0] + PRIOR))), -127, 127).astype(np.int8)


_LEVEL = np.array([0 if x == 0 else 1 if abs(x) < SURE else 2 for x in [*range(128), *range(-128, 0)]], np.uint8)


def gates_of(inputs: np.ndarray) -> np.ndarray:
    """The gate of each bit: how sure the last two contexts are."""
    raw = inputs.view(np.uint8)
    return 3 * _LEVEL.take(raw[:, CONTEXTS - 2]) + _LEVEL.take(raw[:, CONTEXTS - 1])


def gated(inputs: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """What each bit's gated weights make of its inputs, in nats for the value it has."""
    out = np.empty(len(inputs), np.float32)
    ones = np.ones(CONTEXTS, np.float32)
    for at in range(0, len(inputs), 1 << 15):
        part = inputs[at : at + (1 << 15)]
        x = weights.take(gates_of(part), axis=0)
        x *= part.astype(np.float32)
        np.matmul(x, ones, out=out[at : at + len(part)])
    return out


def mix(inputs: np.ndarray, lane: np.ndarray, bits: np.ndarray, weights: np.ndarray, rate: float = RATE) -> np.ndarray:
    """Nats that each lane's bits cost.

    ``inputs``: what the contexts say for each bit's value; ``lane``, ``bits``: where lanes begin and
    how long they are; ``weights``: a row for each gate.  A bit's weights are its gate's and what its
    lane has learned so far.
    """
    order = np.argsort(-bits, kind="stable")
    start, left = lane[order], bits[order]
    active = len(bits) - np.searchsorted(left[::-1], np.arange(int(left[0]) if len(left) else 0), side="right")
    learned = np.zeros((len(bits), CONTEXTS), np.float32)
    ones = np.ones(CONTEXTS, np.float32)
    cost, odds = np.zeros(len(bits)), np.ones(len(bits))
    packed, fixed, rate = inputs.view(np.int32).ravel(), gated(inputs, weights), np.float32(rate / SCALE**2)
    for t, n in enumerate(active.tolist()):
        if t % AHEAD == 0:  # the next bits of each lane lie side by side; turned, those of each step do
            at = start[:n, None] + np.arange(t, t + AHEAD)
            steps, sums = (np.ascontiguousarray(x.take(at, mode="clip").T) for x in (packed, fixed))
        x = steps[t % AHEAD, :n].view(np.int8).reshape(n, CONTEXTS).astype(np.float32)
        own = learned[:n]
        z = (own * x) @ ones
        z += sums[t % AHEAD, :n]
        np.clip(z, -MOST, MOST, out=z)
        np.exp(z, out=z)
        z += 1
        np.reciprocal(z, out=z)  # of the other value
        odds[:n] *= 1 - z
        z *= rate
        x *= z[:, None]
        own += x
        if t % AHEAD == AHEAD - 1:
            cost -= np.log(odds)
            odds[:] = 1
    total = np.empty(len(bits))
    total[order] = cost - np.log(odds)
    return total


def inputs_of(batch: Batch, said: np.ndarray) -> np.ndarray:
    """What the contexts say for each bit of a batch, by what all slots say: four bytes a bit."""
    d = batch.distinct
    sign = 2 * d.bit.view(np.int8) - 1
    columns = np.empty((len(d.node), CONTEXTS), np.int8)
    for k, slot in enumerate(d.slots):
        np.multiply(said.take(slot), sign, out=columns[:, k])
    columns[:, CONTEXTS - 1] = 0
    out = columns.view(np.int32).ravel().take(batch.row).view(np.int8).reshape(-1, CONTEXTS)
    out[batch.pair_at, CONTEXTS - 1] = said.take(batch.pair) * sign.take(batch.pair_row)
    return out


def lane_costs(stream: np.ndarray, starts: np.ndarray, docs: np.ndarray, code: Code, said: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Nats of each document of a stream."""
    lanes, cuts = lanes_of(docs), cuts_of(docs)
    cost = np.zeros(len(lanes) - 1)
    for at, to in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
        batch = batch_of(stream, starts, at, to, code)
        ends = np.r_[0, np.cumsum(batch.bits)]
        a, z = np.searchsorted(lanes, [at, to])
        edge = ends[lanes[a : z + 1] - at]
        cost[a:z] = mix(inputs_of(batch, said), edge[:-1], np.diff(edge), weights)
    return np.add.reduceat(cost, np.searchsorted(lanes, docs[:-1])) if len(docs) > 1 else np.zeros(0)


def fit_weights(inputs: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """The weights of each gate by Newton's steps of a logistic regression on its bits, held near
    equal ones by RIDGE; a step that makes things worse is halved."""
    start = np.full(CONTEXTS, 1.5 / (CONTEXTS * SCALE))
    weights = np.tile(start, (GATES, 1))
    gate = gates_of(inputs)
    for g in np.unique(gate):
        x, w = inputs[gate == g].astype(np.float64), start.copy()

        def loss(v):
            return np.logaddexp(0, -(x @ v)).sum() + RIDGE / 2 * ((v - start) ** 2).sum()

        now = loss(w)
        for _ in range(rounds):
            q = 1 / (1 + np.exp(np.clip(x @ w, -30, 30)))
            slope = RIDGE * (w - start) - x.T @ q
            step = np.linalg.solve((x * (q * (1 - q))[:, None]).T @ x + RIDGE * np.eye(CONTEXTS), slope)
            while (then := loss(w - step)) > now and np.abs(step).max() > 1e-9:
                step /= 2
            w, now = (w - step, then) if then <= now else (w, now)
        weights[g] = w
    return weights.astype(np.float32)


def weighed(batch: Batch, said: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """The inputs of a batch of whole tokens (without each bit's place), and how often each stands there: bits
    that the token before has no say in once for each distinct token, the others one by one."""
    d = batch.distinct
    sign = 2 * d.bit.view(np.int8) - 1
    columns = np.empty((len(d.node), CONTEXTS), np.int8)
    for k, slot in enumerate(d.slots):
        np.multiply(said.take(slot), sign, out=columns[:, k])
    columns[:, CONTEXTS - 1] = 0
    length = np.diff(d.bytes)
    bits = np.diff(d.begin)
    later = np.arange(int(d.bytes[-1])) - np.repeat(d.bytes[:-1], length) >= LEAD
    alone = np.flatnonzero(np.repeat(later, bits))
    times = np.repeat(np.repeat(batch.times, length), bits)[alone]
    lead = columns.view(np.int32).ravel().take(batch.pair_row).view(np.int8).reshape(-1, CONTEXTS)
    lead[:, CONTEXTS - 1] = said.take(batch.pair) * sign.take(batch.pair_row)
    return [(columns[alone], times.astype(np.float32)), (lead, np.ones(len(lead), np.float32))]


#: Of each gate: cost, slope and curve.
SUMS = 1 + CONTEXTS + CONTEXTS**2


def slopes(stream: np.ndarray, starts: np.ndarray, code: Code, said: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Sums over a stream's bits, for each gate (GATES x SUMS): what they cost in nats with these weights, and
    the slope and curve of that cost."""
    out = np.zeros((GATES, SUMS))
    cuts = np.unique(np.append(np.searchsorted(starts[:-1], np.arange(0, len(stream), BATCH)), len(starts) - 1))
    for a, z in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
        for inputs, times in weighed(batch_of(stream, starts, int(starts[a]), int(starts[z]), code, rows=False), said):
            for at in range(0, len(inputs), 1 << 16):
                part = inputs[at : at + (1 << 16)]
                gate = gates_of(part)
                order = np.argsort(gate, kind="stable")
                ends = np.cumsum(np.bincount(gate, minlength=GATES)).tolist()
                x, n = part.take(order, axis=0).astype(np.float32), times[at : at + (1 << 16)].take(order)
                for g, (i, j) in enumerate(zip([0, *ends[:-1]], ends)):
                    if i < j:
                        z_ = np.clip(x[i:j] @ weights[g].astype(np.float32), -30, 30)
                        other = 1 / (1 + np.exp(z_))  # of the other value
                        q = n[i:j] * other
                        out[g, 0] -= (n[i:j] * np.log(1 - np.minimum(other, 1 - np.float32(1e-7)))).sum(dtype=np.float64)
                        out[g, 1 : 1 + CONTEXTS] -= x[i:j].T @ q
                        out[g, 1 + CONTEXTS :] += ((x[i:j] * (q * (1 - other))[:, None]).T @ x[i:j]).ravel()
    return out


def newton(sums: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, float, float]:
    """The weights after one of Newton's steps with these ``slopes``, held as in ``fit_weights``; the cost before
    it, and what the step takes off, to first order."""
    away = weights - 1.5 / (CONTEXTS * SCALE)
    slope = sums[:, 1 : 1 + CONTEXTS] + RIDGE * away
    step = np.linalg.solve(sums[:, 1 + CONTEXTS :].reshape(-1, CONTEXTS, CONTEXTS) + RIDGE * np.eye(CONTEXTS), slope[:, :, None])[:, :, 0]
    return weights - step, float(sums[:, 0].sum() + RIDGE / 2 * (away**2).sum()), float((step * slope).sum() / 2)


_TIMES = np.cumprod(np.full(1 << 16, _ODD, np.uint64), dtype=np.uint64)


def word_classes(stream: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Number of each token (from one bound up to the next) among the distinct ones, the first token of
    each, and their hashes.  Tokens are told apart by hash and length, then compared byte for byte."""
    length = np.diff(bounds)
    hashed = np.empty(len(length), np.uint64)
    cuts = np.unique(np.append(np.searchsorted(bounds[:-1], np.arange(0, len(stream), BATCH)), len(length)))
    parts = list(zip(cuts[:-1].tolist(), cuts[1:].tolist()))

    def inside(a: int, z: int) -> np.ndarray:
        return np.arange(int(bounds[a]), int(bounds[z])) - np.repeat(bounds[a:z], length[a:z])

    for a, z in parts:
        terms = stream[bounds[a] : bounds[z]].astype(np.uint64)
        terms += np.uint64(1)
        terms *= _TIMES.take(inside(a, z), mode="wrap")
        hashed[a:z] = np.add.reduceat(terms, bounds[a:z] - bounds[a])
    hashed ^= length.astype(np.uint64) * _BACK

    def firsts(number: np.ndarray, n: int) -> np.ndarray:
        index = np.empty(n, np.int64)
        index[number[::-1]] = np.arange(len(number) - 1, -1, -1)
        return index

    number, kinds = pd.factorize(hashed)
    index = firsts(number, len(kinds))
    same = bool((length[index][number] == length).all())
    for a, z in parts if same else []:
        like = np.repeat(bounds[index][number[a:z]] - bounds[a:z], length[a:z])
        like += np.arange(int(bounds[a]), int(bounds[z]))
        same &= np.array_equal(stream.take(like), stream[bounds[a] : bounds[z]])
    if not same:  # two tokens of one hash
        raw = stream.tobytes()
        number, kinds = pd.factorize(np.array([*(raw[a:z] for a, z in zip(bounds[:-1].tolist(), bounds[1:].tolist())), None], object)[:-1])
        index = firsts(number, len(kinds))
    return number, index, hashed[index]
