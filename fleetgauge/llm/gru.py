"""A gated recurrent language model in numpy with a class-factored softmax."""

from __future__ import annotations

import heapq

import numpy as np

Weights = dict[str, np.ndarray]


def new_weights(words: int, classes: int, embed: int, hidden: int, seed: int = 0) -> Weights:
    """Word w belongs to class w // width and is number w % width in it; ``words`` is classes * width."""
    rng = np.random.default_rng(seed)
    width = words // classes

    def drawn(*shape: int) -> np.ndarray:
        return (rng.standard_normal(shape) / np.sqrt(shape[-2])).astype(np.float32)

    return {"embed": drawn(words, embed) * np.float32(np.sqrt(words) * 0.3), "inner": drawn(embed, 3 * hidden), "bias": np.zeros(3 * hidden, np.float32),
            "gates": drawn(hidden, 2 * hidden), "state": drawn(hidden, hidden), "classes": drawn(hidden, classes) * np.float32(0.3),
            "class_bias": np.zeros(classes, np.float32), "members": drawn(classes, hidden, width) * np.float32(0.3),
            "member_bias": np.zeros((classes, width), np.float32)}


# Arrays inside have a row per unit and a column per lane or token: numpy's loops then run along the many columns.


def _run(w: Weights, tokens: np.ndarray, h: np.ndarray, lanes: np.ndarray | None = None, begins: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
    """States (steps x hidden x lanes) after each of ``tokens`` (steps x lanes) from ``h`` (hidden x lanes), and what
    backpropagation needs: gates, reset states, fresh states. Where ``begins`` (steps x lanes), the state before is zero."""
    hidden, (steps, width) = len(h), tokens.shape
    table = w["given"] if "given" in w else w["embed"] @ w["inner"] + w["bias"]
    sign = np.repeat(np.array([-1, 1], table.dtype), [2 * hidden, hidden])       # the sigmoid takes e to the minus x
    given = np.take(np.ascontiguousarray((table * sign).T), tokens, axis=1)
    into_gates, into_state = np.ascontiguousarray(-w["gates"].T), np.ascontiguousarray(w["state"].T)
    states, gates, pulled, fresh = (np.empty((steps, k * hidden, width), table.dtype) for k in (1, 2, 1, 1))
    old, anew = h, np.zeros(steps, bool) if begins is None else begins.any(axis=1)
    for t in range(steps):
        gate, back, new, out, x = gates[t], pulled[t], fresh[t], states[t], given[:, t]
        before = old * ~begins[t] if anew[t] else old
        n = width if lanes is None else lanes[t]
        if n < width:                                     # lanes at their end keep their state
            out[:, n:] = old[:, n:]
            gate, back, new, out, x, before = (a[:, :n] for a in (gate, back, new, out, x, before))
        np.matmul(into_gates, before, out=gate)
        gate += x[:2 * hidden]
        np.exp(gate, out=gate)
        gate += 1
        np.reciprocal(gate, out=gate)
        np.multiply(gate[hidden:], before, out=back)
        np.matmul(into_state, back, out=new)
        new += x[2 * hidden:]
        np.tanh(new, out=new)
        np.subtract(new, before, out=out)
        out *= gate[:hidden]
        out += before
        old = states[t]
    return states, gates, pulled, fresh


def _flat(x: np.ndarray) -> np.ndarray:
    """steps x units x lanes as units x tokens."""
    return x.transpose(1, 0, 2).reshape(x.shape[1], -1)


def run_window(w: Weights, tokens: np.ndarray, h: np.ndarray, lanes: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """States (steps x lanes x hidden) after each of ``tokens`` (steps x lanes), starting from ``h`` (lanes x hidden), and
    the last state.

    ``lanes`` gives how many lanes (the first ones) are still running at each step; others keep their state.
    """
    states = _run(w, tokens, h.T, lanes)[0].transpose(0, 2, 1)
    return states, states[-1]


def _softmax(x: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Turns each column into e to its entries, less the largest; the log softmax at one row of each column, and the sums."""
    x -= x.max(axis=0)
    picked = x[target, np.arange(len(target))]
    np.exp(x, out=x)
    sums = x.sum(axis=0)
    return picked - np.log(sums), sums


def _by_class(group: np.ndarray, classes: int) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
    """The order of the tokens by class; class, first, end of each class there is."""
    ends = np.cumsum(np.bincount(group, minlength=classes)).tolist()
    return np.argsort(group.astype(np.int16), kind="stable"), [(c, a, b) for c, (a, b) in enumerate(zip([0, *ends], ends)) if b > a]


def _with_one(flat: np.ndarray) -> np.ndarray:
    """The states and a row of ones, the biases' input."""
    return np.concatenate([flat, np.ones((1, flat.shape[1]), flat.dtype)])


def _output(w: Weights) -> tuple[np.ndarray, np.ndarray]:
    """The weights of the classes and of their members, each with its bias as the last row."""
    return np.concatenate([w["classes"], w["class_bias"][None]]), np.concatenate([w["members"], w["member_bias"][:, None]], axis=1)


def _member_scores(members: np.ndarray, states: np.ndarray, spans: list[tuple[int, int, int]]) -> np.ndarray:
    out = np.empty((members.shape[2], states.shape[1]), states.dtype)
    for c, a, b in spans:
        np.matmul(members[c].T, states[:, a:b], out=out[:, a:b])
    return out


def _log_probabilities(w: Weights, states: np.ndarray, targets: np.ndarray) -> np.ndarray:
    classes, members = _output(w)
    group, member = np.divmod(targets, members.shape[2])
    states = _with_one(states)
    out = _softmax(classes.T @ states, group)[0]
    order, spans = _by_class(group, len(members))
    out[order] += _softmax(_member_scores(members, np.take(states, order, axis=1), spans), member[order])[0]
    return out


def log_probabilities(w: Weights, states: np.ndarray, targets: np.ndarray) -> np.ndarray:
    """Natural log probability of each target (flat) after each state: its class, then its word in the class."""
    return _log_probabilities(w, np.ascontiguousarray(states.T), targets)


def gradients(w: Weights, inputs: np.ndarray, targets: np.ndarray, h: np.ndarray) -> tuple[Weights, float, np.ndarray]:
    """Backpropagation through one window (steps x lanes): gradients, mean loss, last state."""
    states, gates, pulled, fresh = _run(w, inputs, h.T)
    hidden, width = h.shape[1], w["members"].shape[2]
    classes, members = _output(w)
    flat, goal = _with_one(_flat(states)), targets.reshape(-1)
    n, every = len(goal), np.arange(len(goal))
    group, member = np.divmod(goal, width)
    wrong = classes.T @ flat
    logs, sums = _softmax(wrong, group)
    loss = -logs.sum()
    wrong /= sums
    wrong[group, every] -= 1
    by_class = flat @ wrong.T
    back = w["classes"] @ wrong
    order, spans = _by_class(group, len(members))
    place, sorted_flat, member = np.empty_like(order), np.take(flat, order, axis=1), member[order]
    place[order] = every
    miss = _member_scores(members, sorted_flat, spans)
    logs, sums = _softmax(miss, member)
    loss -= logs.sum()
    miss /= sums
    miss[member, every] -= 1
    through, by_member = np.empty_like(back), np.zeros_like(members)
    for c, a, b in spans:
        part = miss[:, a:b]
        np.matmul(sorted_flat[:, a:b], part.T, out=by_member[c])
        np.matmul(w["members"][c], part, out=through[:, a:b])
    g = {"classes": by_class[:-1], "class_bias": by_class[-1], "members": by_member[:, :-1], "member_bias": by_member[:, -1]}
    back += np.take(through, place, axis=1)
    back = back.reshape(hidden, *inputs.shape)
    old = np.concatenate([h.T[None], states[:-1]])
    update, reset = gates[:, :hidden], gates[:, hidden:]
    keep, to_fresh, to_update, to_reset = 1 - update, 1 - fresh * fresh, fresh - old, 1 - reset
    to_fresh *= update
    to_update *= update
    to_update *= keep
    to_reset *= reset
    to_reset *= old
    given = np.empty((len(inputs), 3 * hidden, h.shape[0]), states.dtype)
    carry = np.zeros_like(states[0])
    for t in range(len(inputs) - 1, -1, -1):
        d = back[:, t] + carry
        d_update, d_reset, d_fresh = given[t, :hidden], given[t, hidden:2 * hidden], given[t, 2 * hidden:]
        np.multiply(d, to_fresh[t], out=d_fresh)
        d_pulled = w["state"] @ d_fresh
        np.multiply(d, to_update[t], out=d_update)
        np.multiply(d_pulled, to_reset[t], out=d_reset)
        carry = w["gates"] @ given[t, :2 * hidden]
        d *= keep[t]
        carry += d
        d_pulled *= reset[t]
        carry += d_pulled
    spread, token = _flat(given), inputs.reshape(-1)
    g["gates"], g["state"] = _flat(old) @ spread[:2 * hidden].T, _flat(pulled) @ spread[2 * hidden:].T
    g["inner"], g["bias"] = (spread @ w["embed"][token]).T, spread.sum(axis=1)
    words, embed = w["embed"].shape
    place = token * embed + np.arange(embed)[:, None]
    g["embed"] = np.bincount(place.reshape(-1), weights=(w["inner"] @ spread).reshape(-1), minlength=words * embed).reshape(words, embed)
    return {k: (g[k] / n).astype(v.dtype, copy=False) for k, v in w.items()}, float(loss / n), states[-1].T


def train(w: Weights, texts: list[np.ndarray], lanes: int = 32, window: int = 32, rate: float = 0.01, moments: dict | None = None) -> tuple[Weights, int, float]:
    """One pass of truncated backpropagation with Adam over token sequences laid end to end in ``lanes`` lanes.

    Each text begins after word 0. State is carried from window to window. Returns weights, tokens, mean loss.
    ``moments`` (empty at first) carries Adam's averages from one call to the next, for streams too long for one.
    """
    stream = np.concatenate([np.zeros(0, np.int64), *[np.concatenate([[0], t]) for t in texts]]).astype(np.int64)
    steps = (len(stream) - 1) // lanes
    if steps < 1:
        return w, 0, 0.0
    grid = stream[:steps * lanes].reshape(lanes, steps).T
    after = stream[1:steps * lanes + 1].reshape(lanes, steps).T
    names, shapes = list(w), [v.shape for v in w.values()]
    ends = np.cumsum([v.size for v in w.values()])
    joined = lambda x: np.concatenate([x[k].reshape(-1) for k in names])
    every = joined(w)                                     # all weights in one row, w has views of it
    w = {k: v.reshape(shape) for k, v, shape in zip(names, np.split(every, ends[:-1]), shapes)}
    moments = {} if moments is None else moments
    mean, square, k = moments.get("held") or (np.zeros_like(every), np.zeros_like(every), 0)
    h, losses = np.zeros((lanes, w["state"].shape[0]), np.float32), []
    for at in range(0, steps, window):
        g, loss, h = gradients(w, grid[at:at + window], after[at:at + window], h)
        k += 1
        v = joined(g)
        v *= np.float32(min(1.0, 1.0 / max(float(np.sqrt(v @ v)), 1e-9)))
        mean += np.float32(0.1) * (v - mean)
        square += np.float32(0.01) * (v * v - square)
        every -= np.float32(rate) * (mean / np.float32(1 - 0.9 ** k)) / (np.sqrt(square / np.float32(1 - 0.99 ** k)) + np.float32(1e-6))
        losses.append(loss)
    moments["held"] = mean, square, k
    return w, steps * lanes, float(np.mean(losses[-max(1, len(losses) // 4):]))


def score_texts(w: Weights, texts: list[np.ndarray], lanes: int = 256, window: int = 32) -> np.ndarray:
    """Natural log probability of each whole text. Texts are dealt to ``lanes``, the longest first, each to the lane
    with the fewest tokens, and run side by side, window after window with the state carried on; a lane whose text ends
    goes on with its next one from an empty state."""
    sizes = np.array([len(t) for t in texts], np.int64)
    loads, dealt = [(0, k) for k in range(min(lanes, len(texts)))], [[] for _ in range(min(lanes, len(texts)))]
    for i in np.argsort(-sizes, kind="stable").tolist():
        load, lane = loads[0]
        dealt[lane].append(i)
        heapq.heapreplace(loads, (load + int(sizes[i]), lane))
    dealt = [rows for _, rows in sorted(((-load, dealt[lane]) for load, lane in loads), key=lambda x: x[0])]
    rows = np.array([i for lane in dealt for i in lane], np.int64)          # the texts one lane after the other
    targets = np.concatenate([np.zeros(0, np.int64), *[texts[i] for i in rows]])
    if not len(targets):
        return np.zeros(len(texts))
    owner, first = np.repeat(rows, sizes[rows]), (np.cumsum(sizes[rows]) - sizes[rows])[sizes[rows] > 0]
    inputs, begins = np.append(0, targets[:-1]), np.zeros(len(targets), bool)
    inputs[first], begins[first] = 0, True
    load = np.array([sizes[lane].sum() for lane in dealt], np.int64)
    begin = np.cumsum(load) - load
    w, out = w | {"given": w["embed"] @ w["inner"] + w["bias"]}, np.zeros(len(texts))
    h = np.zeros((w["state"].shape[0], len(load)), np.float32)
    for at in range(0, int(load[0]), window):
        live = int((load > at).sum())
        step = at + np.arange(min(window, int(load[0]) - at))[:, None]
        running = step < load[:live]
        place = begin[:live] + np.minimum(step, load[:live] - 1)
        states = _run(w, inputs[place], h[:, :live], running.sum(axis=1), begins[place] & running)[0]
        h, flat, place = states[-1], _flat(states), place[running]
        logs = _log_probabilities(w, flat if running.all() else flat[:, running.reshape(-1)], targets[place])
        out += np.bincount(owner[place], weights=logs, minlength=len(texts))
    return out
