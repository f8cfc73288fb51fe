"""A small causal self-attention model over subword ids, in numpy.

The output is a class of ids first and then an id of the class, so a token costs two short lookups
instead of a sum over the vocabulary. Classes come from counts of the whole corpus: the most frequent
ids are classes of their own, the others are clustered by what stands before them.
"""

from __future__ import annotations

import numpy as np

CLASSES = 64
SINGLE = 24
ROWS = 1024
WIDTH = 16
# Each window scores its last STEP tokens; the tokens before them are context only.
STEP, CONTEXT = 16, 16
SPAN = STEP + CONTEXT
BUCKETS = 16
# Scores are cut off here, far above any that occurs, so that no exponential overflows.
HIGHEST = np.float32(40)
SCALE = np.float32(WIDTH ** -0.5)


class Tables:
    """Class and input row of every id, and log probability of an id within its class."""

    def __init__(self, counts: np.ndarray, before: np.ndarray):
        size = len(counts)
        order = np.argsort(-counts, kind="stable")
        self.class_of = np.empty(size, np.int64)
        self.class_of[order[:SINGLE]] = np.arange(SINGLE)
        rest = order[SINGLE:]
        self.class_of[rest] = SINGLE + self._clusters(np.sqrt(counts[rest] + 0.0), self._directions(before[rest]), CLASSES - SINGLE)
        smooth = counts + 0.5
        mass = np.bincount(self.class_of, smooth, minlength=CLASSES)
        self.within = np.log(smooth / mass[self.class_of])
        self.prior = np.log(np.maximum(mass, 0.5) / mass.sum())
        own = ROWS - CLASSES - 1
        self.row_of = own + self.class_of
        self.row_of[order[:own]] = np.arange(size)[:own]
        self.begin = ROWS - 1
        # id -1, the beginning of a text, is the last one
        self.input_of = np.append(self.row_of, self.begin).astype(np.int16)

    def inputs(self, ids: np.ndarray) -> np.ndarray:
        """Input rows of ids; -1 is the beginning of a text."""
        return np.take(self.input_of, ids, mode="wrap")

    @staticmethod
    def _directions(before: np.ndarray) -> np.ndarray:
        x = np.sqrt(before)
        return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)

    @staticmethod
    def _clusters(weight: np.ndarray, points: np.ndarray, k: int) -> np.ndarray:
        """Spherical k-means from the heaviest points; ids that never occur are spread evenly."""
        label = np.arange(len(points)) % k
        seen = np.flatnonzero(weight > 0)
        if len(seen) >= k:
            x, w = points[seen], weight[seen]
            centres = x[:k].copy()
            for _ in range(15):
                near = (x @ centres.T).argmax(1)
                for c in range(points.shape[1]):
                    centres[:, c] = np.bincount(near, w * x[:, c], minlength=k)
                centres /= np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-9)
            label[seen] = near
        return label


SHAPES = {"rows": (ROWS, WIDTH), "places": (SPAN, WIDTH), "query": (WIDTH, WIDTH), "key": (WIDTH, WIDTH),
          "value": (WIDTH, WIDTH), "mix": (WIDTH, WIDTH), "out": (WIDTH, CLASSES), "bias": (CLASSES,)}
SIZES = {name: int(np.prod(shape)) for name, shape in SHAPES.items()}


class Model:
    """One attention layer with a residual, and u / (1 + |u|) before the output.

    Queries meet keys, and values the mix, through products of their two matrices, which are made once
    for all windows; so no place of a window is projected but the targets'.
    """

    def __init__(self, flat: np.ndarray):
        self.flat = flat.astype(np.float32, copy=False)
        self.parts = views(self.flat)

    @classmethod
    def fresh(cls, prior: np.ndarray) -> Model:
        """Starts at the classes' shares of the corpus."""
        random = np.random.RandomState(7)
        model = cls(np.concatenate([random.randn(n) * 0.1 for n in SIZES.values()]))
        for name in ("query", "key", "value", "mix"):
            model.parts[name] *= np.float32(3)
        model.parts["bias"][:] = prior
        return model

    def _attend(self, rows: np.ndarray, open_: np.ndarray):
        p, n = self.parts, len(rows)
        x = np.take(p["rows"], rows, axis=0)
        x += p["places"]
        across = np.ascontiguousarray(x.transpose(0, 2, 1))
        own = np.ascontiguousarray(x[:, CONTEXT:]).reshape(-1, WIDTH)
        q = (own @ (p["query"] @ p["key"].T * SCALE)).reshape(n, STEP, WIDTH)
        s = q @ across
        if s.max(initial=0) > HIGHEST:
            np.minimum(s, HIGHEST, out=s)
        np.exp(s, out=s)
        s *= PAST
        closed = np.flatnonzero(~open_.all(1))
        if len(closed):
            s[closed] *= open_[closed].astype(np.float32)[:, None, :]
        # s is not divided by its sums; these stand in front of the narrower sums over places
        per = (1 / (s.reshape(-1, SPAN) @ SUM_PLACES)).repeat(WIDTH).reshape(-1, WIDTH)
        seen = (s @ x).reshape(-1, WIDTH)
        mean = seen * per
        h = mean @ (p["value"] @ p["mix"])
        h += own
        h /= 1 + np.abs(h)
        return x, across, own, q, s, per, seen, mean, h

    def _odds(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of the classes without their bias, and the factors that the bias adds."""
        z = h @ self.parts["out"]
        # |h| < 1
        if np.abs(self.parts["out"]).sum(0).max() > HIGHEST:
            np.minimum(z, HIGHEST, out=z)
        return z, np.exp(np.minimum(self.parts["bias"], HIGHEST))

    def class_scores(self, rows: np.ndarray, open_: np.ndarray, targets: np.ndarray) -> np.ndarray:
        """Natural log probability of the target classes of a batch of windows."""
        z, factor = self._odds(self._attend(rows, open_)[-1])
        picked = np.take(z, cells(targets))
        np.exp(z, out=z)
        return (picked - np.log(z @ factor)).reshape(targets.shape) + np.log(factor)[targets]

    def gradient(self, rows: np.ndarray, open_: np.ndarray, targets: np.ndarray, counted: np.ndarray) -> np.ndarray:
        """Of the mean loss of the counted targets. Works in place and keeps factors of rows out of the wide
        arrays, for training is most of the operator's time."""
        p, n = self.parts, len(rows)
        x, across, own, q, s, per, seen, mean, h = self._attend(rows, open_)
        flat = np.empty_like(self.flat)
        g = views(flat)
        z, factor = self._odds(h)
        np.exp(z, out=z)
        total = z @ factor
        weight = (counted.ravel() / np.float32(max(1, counted.sum()))).astype(np.float32) / total
        # z times factor and weight is the gradient of the odds
        at = cells(targets)
        z.reshape(-1)[at] -= total / factor[targets.ravel()]
        np.multiply(weight @ z, factor, out=g["bias"])
        wide = weight.repeat(WIDTH).reshape(-1, WIDTH)
        np.multiply((h * wide).T @ z, factor, out=g["out"])
        dh = z @ (p["out"] * factor).T
        dh *= wide
        np.abs(h, out=h)
        np.subtract(1, h, out=h)
        h *= h
        dh *= h
        both = mean.T @ dh
        np.matmul(both, p["mix"].T, out=g["value"])
        np.matmul(p["value"].T, both, out=g["mix"])
        dseen = dh @ (p["value"] @ p["mix"]).T
        dseen *= per
        # the sum over places of s * ds is the product of what was seen and its gradient
        mean *= dseen
        inner = mean @ SUM_WIDTH
        seen *= inner
        inner *= q.reshape(-1, WIDTH)
        ds = dseen.reshape(n, STEP, WIDTH) @ across
        ds *= s
        dq = (ds @ x).reshape(-1, WIDTH)
        dq -= seen
        dseen -= inner
        dx = s.transpose(0, 2, 1) @ dseen.reshape(n, STEP, WIDTH)
        dx += ds.transpose(0, 2, 1) @ q
        both = own.T @ dq * SCALE
        np.matmul(both, p["key"], out=g["query"])
        np.matmul(both.T, p["query"], out=g["key"])
        dh += dq @ (p["key"] @ p["query"].T * SCALE)
        dx[:, CONTEXT:] += dh.reshape(n, STEP, WIDTH)
        np.add.reduce(dx, axis=0, out=g["places"])
        g["rows"][:] = _sums_by_row(rows.ravel(), dx.reshape(-1, WIDTH))
        return flat


# Sums of short rows by products; those of the width stand in every column.
SUM_PLACES, SUM_WIDTH = np.ones(SPAN, np.float32), np.ones((WIDTH, WIDTH), np.float32)
# Two numbers are added at a time, as one complex number.
PAIRS = np.arange(ROWS * WIDTH // 2).reshape(ROWS, -1)


def views(flat: np.ndarray) -> dict[str, np.ndarray]:
    """The parameters' parts of ``flat``."""
    parts, at = {}, 0
    for name, shape in SHAPES.items():
        parts[name] = flat[at:at + SIZES[name]].reshape(shape)
        at += SIZES[name]
    return parts


def cells(targets: np.ndarray) -> np.ndarray:
    """Places of the targets' classes in an array of one line of classes for each target."""
    return np.arange(0, targets.size * CLASSES, CLASSES) + targets.ravel()


def _sums_by_row(rows: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Sums of the values (one line for each place) by input row."""
    out = np.zeros(ROWS * WIDTH // 2, np.complex64)
    np.add.at(out, np.take(PAIRS, rows, axis=0).ravel(), np.ascontiguousarray(values, np.float32).reshape(-1).view(np.complex64))
    return out.view(np.float32).reshape(ROWS, WIDTH)


# The token at target place t is predicted from the inputs up to t, whose last one is the token before.
PAST = (np.arange(SPAN)[None, :] <= (np.arange(STEP) + CONTEXT)[:, None]).astype(np.float32)


def windows(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Text and first target place of every window: each token is the target of exactly one."""
    n = -(-lengths // STEP)
    text = np.repeat(np.arange(len(lengths)), n)
    first = (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)) * STEP
    return text, first


def window_ids(ids: np.ndarray, offsets: np.ndarray, text: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Inputs (ids one place before the targets), which of them exist, targets and which of those exist."""
    base, length = offsets[text], offsets[text + 1] - offsets[text]
    places = np.arange(-CONTEXT - 1, STEP)
    got = np.take(ids, (base + first)[:, None] + places, mode="clip").astype(np.int64, copy=False)
    inside = np.ones(got.shape, bool)
    open_ = np.ones((len(got), SPAN), bool)
    # only windows at an end of a text have places outside of it
    some = np.flatnonzero((first <= CONTEXT) | (first + STEP > length))
    at = first[some, None] + places
    inside[some] = (at >= 0) & (at < length[some, None])
    # place -1 is the beginning of the text, which every token may look at
    begin = at == -1
    open_[some] = (inside[some] | begin)[:, :-1]
    got[some] = np.where(begin, -1, np.where(inside[some], got[some], 0))
    return got[:, :-1], open_, got[:, CONTEXT + 1:], inside[:, CONTEXT + 1:]


def train(model: Model, batches, rate: float = 0.01) -> Model:
    """Adam over the batches (rows, open, target classes, counted), once."""
    model = Model(model.flat.copy())
    mean, square = np.zeros_like(model.flat), np.zeros_like(model.flat)
    for step, batch in enumerate(batches, 1):
        g = model.gradient(*batch)
        # ten times the mean and a hundred times the mean square; what is left is one factor and one addend
        mean *= np.float32(0.9)
        mean += g
        g *= g
        square *= np.float32(0.99)
        square += g
        size = np.sqrt(square, out=g)
        scale = 0.1 * (1 - 0.99 ** step) ** -0.5
        size += np.float32(1e-6 / scale)
        np.divide(mean, size, out=size)
        size *= np.float32(0.1 * rate / (1 - 0.9 ** step) / scale)
        model.flat -= size
    return model
