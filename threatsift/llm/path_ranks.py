"""Cheapest edits of role sequences: cost DP and prefix-doubled path ranks.

A *segment* is a run of consecutive rows of one conversation, one code per row.
Nodes are (position in the segment, state); the state says what the repaired
sequence ends with. Arcs are edits. Everything is vectorised over many segments.
"""

from __future__ import annotations

import numpy as np

# States: nothing yet, after system, after user, after assistant.
STATES = 4
FINAL = (0, 3)
INITIALS = {"s": 0, "u": 1, "a": 2}
TRUNCATED, MUST_GO = 4, 8                       # added to the initial's number (3: any other)
NEXT = np.array([2, 2, 3, 2])                   # state after the one role that user/assistant may add
KEPT = np.array([[1, 2, -1], [-1, 2, -1], [-1, -1, 3], [-1, 2, -1]])    # state after keeping s, u, a
LABELS = "DIKR"                                 # edits in ASCII order
DELETE, INSERT, KEEP, REROLE = range(4)
FAR = np.int64(1) << 60
COSTS = {"keep": 0, "rerole": 1, "delete": 2, "insert": 5, "truncated": 5}


def row_arcs(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(cost, next state), each (rows, states, labels), of a row's own edits."""
    n = len(codes)
    cost = np.full((n, STATES, 4), FAR)
    to = np.zeros((n, STATES, 4), dtype=np.int64)
    cost[:, :, DELETE] = COSTS["delete"]
    to[:, :, DELETE] = np.arange(STATES)
    stay = (codes & MUST_GO) == 0
    extra = np.where(codes & TRUNCATED, COSTS["truncated"], 0)
    initial = codes & 3
    kept = np.where((initial < 3)[:, None], KEPT[:, np.minimum(initial, 2)].T, -1)
    may = stay[:, None] & (kept >= 0)
    cost[:, :, KEEP] = np.where(may, COSTS["keep"] + extra[:, None], FAR)
    to[:, :, KEEP] = np.where(may, kept, 0)
    cost[:, :, REROLE] = np.where(stay[:, None], COSTS["rerole"] + extra[:, None], FAR)
    to[:, :, REROLE] = NEXT
    return cost, to


def _with_inserts(c: np.ndarray) -> np.ndarray:
    """Costs to go (..., states) when roles may be inserted first."""
    step = COSTS["insert"]
    out = c.copy()
    out[..., 2] = np.minimum(c[..., 2], step + c[..., 3])
    out[..., 3] = np.minimum(c[..., 3], step + c[..., 2])
    for s in (0, 1):
        out[..., s] = np.minimum(c[..., s], step + out[..., 2])
    return out


def padded(segments: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(codes aligned to their ends, lengths): shorter segments have -1 in front."""
    size = np.array([len(s) for s in segments])
    out = np.full((len(segments), int(size.max())), -1, dtype=np.int64)
    for row, s in zip(out, segments):
        if len(s):
            row[-len(s):] = s
    return out, size


def costs_to_go(codes: np.ndarray, exits: np.ndarray, last: np.ndarray) -> np.ndarray:
    """(segments, positions + 1, states, exits' columns): least cost from every
    node to the segment's end plus ``exits`` (segments, states, columns). Only a
    ``last`` segment inserts behind its last row."""
    n, length = codes.shape
    out = np.full((n, length + 1, STATES, exits.shape[2]), FAR)
    tail = np.moveaxis(_with_inserts(np.moveaxis(exits, 1, -1)), -1, 1)
    out[:, length] = np.where(last[:, None, None], tail, exits)
    for j in range(length - 1, -1, -1):
        on = codes[:, j] >= 0
        cost, to = row_arcs(codes[on, j])
        after = out[on, j + 1]
        best = np.full(after.shape, FAR)
        for label in (DELETE, KEEP, REROLE):
            target = np.take_along_axis(after, to[:, :, label][:, :, None], axis=1)
            best = np.minimum(best, cost[:, :, label][:, :, None] + target)
        out[on, j] = np.moveaxis(_with_inserts(np.moveaxis(best, 1, -1)), -1, 1)
        out[~on, j] = out[~on, j + 1]
    return np.minimum(out, FAR)


def matrices(codes: np.ndarray, last: np.ndarray) -> np.ndarray:
    """(segments, entry state, exit state): least cost through each segment."""
    unit = np.where(np.eye(STATES, dtype=bool), np.int64(0), FAR)
    return costs_to_go(codes, np.broadcast_to(unit, (len(codes), STATES, STATES)).copy(), last)[:, 0]


def end_costs() -> np.ndarray:
    return np.where(np.isin(np.arange(STATES), FINAL), np.int64(0), FAR)


def ranked_paths(codes: np.ndarray, size: np.ndarray, exits: np.ndarray, last: np.ndarray) -> tuple[list[list[str]], np.ndarray]:
    """(audit of every entry state, exit state of every entry state) per segment:
    of the cheapest paths to ``exits`` (segments, states) the one whose labels
    come first in ASCII order.

    Nodes are ranked by the first 2**k labels of their least optimal path: a
    round combines a node's rank with the rank of the node 2**k steps ahead and
    doubles the pointers. The final ranks order whole audits; they select each
    node's arc, and the doubled pointers spell the path."""
    n, length = codes.shape
    go = costs_to_go(codes, exits[:, :, None], last)[..., 0]
    shape = go.shape                                               # segments, positions + 1, states
    node = np.arange(go.size).reshape(shape)
    arc_to = np.full((*shape, 4), -1)
    for j in range(length):
        on = np.flatnonzero(codes[:, j] >= 0)
        cost, to = row_arcs(codes[on, j])
        for label in (DELETE, KEEP, REROLE):
            target = np.take_along_axis(go[on, j + 1], to[:, :, label], axis=1)
            good = (cost[:, :, label] < FAR) & (cost[:, :, label] + target == go[on, j]) & (target < FAR)
            at = np.take_along_axis(node[on, j + 1], to[:, :, label], axis=1)
            arc_to[on, j, :, label] = np.where(good, at, -1)
    ahead = go[:, :, NEXT]
    may = (ahead + COSTS["insert"] == go) & (ahead < FAR)
    may[:, :-1] &= (codes >= 0)[:, :, None]
    may[:, -1] &= last[:, None] & (exits > go[:, -1])
    arc_to[..., INSERT] = np.where(may, node[:, :, NEXT], -1)
    arc_to = arc_to.reshape(-1, 4)

    ends = (arc_to < 0).all(1)
    first = np.where(ends, 0, (arc_to >= 0).argmax(1))             # labels of one node's arcs differ
    label = np.where(ends, 0, first + 1)                           # 0: end of the path, before every label
    step = np.where(ends, np.arange(len(arc_to)), np.take_along_axis(arc_to, first[:, None], axis=1)[:, 0])
    rank, pointers = label.copy(), [step]
    while (pointers[-1] != pointers[-1][pointers[-1]]).any():
        p = pointers[-1]
        rank = np.unique(rank * np.int64(len(rank) + 5) + rank[p], return_inverse=True)[1]
        pointers.append(p[p])
    if len(pointers) > 1:                                          # select arcs by label, then by the rank they lead to
        order = np.where(arc_to >= 0, np.arange(4) * np.int64(len(rank) + 1) + rank[np.maximum(arc_to, 0)], FAR)
        label = np.where(ends, 0, order.argmin(1) + 1)

    begin = length - size
    starts = node[np.arange(n), begin]                             # (segments, states)
    steps = int(2 ** len(pointers))
    at = np.empty((starts.size, steps), dtype=np.int64)
    at[:, 0] = starts.ravel()
    for k, p in enumerate(pointers):                               # steps 2**k .. 2**(k+1)-1 are 2**k behind the earlier ones
        at[:, 2 ** k:2 ** (k + 1)] = p[at[:, :2 ** k]]
    letters = np.frombuffer(b" " + LABELS.encode(), dtype="S1")
    audits = [row.tobytes().rstrip(b" ").decode() for row in letters[label[at]]]
    exit_state = (at[:, -1] % STATES).reshape(n, STATES)
    return [audits[i:i + STATES] for i in range(0, len(audits), STATES)], exit_state
