"""Secret scanning: base patterns, and further spans from a linear-chain conditional random field.

* Base kinds (assign, access, hex) are matched in the whole text, leftmost and non-overlapping per
  kind; a span is the whole match.
* Tokens are the runs without white space, tagged O (outside), B (begin) or I (inside).  A token's
  features are its shape (length, digits, letter cases, hex only, changes between letters and digits,
  quotes, signs), its neighbours (a key word or an assignment sign before it, the shape after it) and
  its document (key words, share of digits).  They are packed into one small code, so a model is one
  table of scores by code.
* The model learns from at most `TRAIN_DOCS` documents with and as many without base spans, sampled by
  hash: windows of tokens around the base spans, and as many others.  Tokens inside a base span's
  value are labelled B and I.  Weights: gradient ascent (Adam) on the penalised
  log-likelihood (forward-backward), on the driver, on that bounded sample.
* Decoding is Viterbi over the whole text.  A token whose score for O exceeds both others by more
  than any transitions can give back is O on the best path, so only the stretches between such
  tokens are decoded; the result is that of decoding everything.
* Tagged spans (without quotes and closing signs) that overlap no base span are added as kind `crf`.

Each task works on one document at a time, with numpy over its bytes; nothing is shuffled but the
sample.

Defined cases: null counts as empty and has no spans; base_sha256 is then that of the empty string.
Without base spans anywhere nothing is learned and nothing added.  Repeated rows are each returned, a
null doc_id too (never learned from).  Without rows there are none.  Other columns are neither read
nor returned.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vaultlake.llm.common import checkpointed

ASSIGN = re.compile(r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
KINDS = ("assign", "access", "hex")
KEYWORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key", b"api-key", b"credential", b"private")
NAMES = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")

TRAIN_DOCS = 800
WINDOW = 12
STEPS, RATE, PENALTY = 80, 0.2, 1e-4
#: Field sizes of a token's code: length, digit share, case, hex only, changes, quoted, signs,
#: assignment before, key word before, shape after, document's key words, document's digits.
FIELDS = (6, 3, 3, 2, 3, 2, 2, 2, 2, 2, 2, 2)
_DIGIT, _UPPER, _LOWER, _SPACE = (np.zeros(256, dtype=bool) for _ in range(4))
_DIGIT[48:58] = _UPPER[65:91] = _LOWER[97:123] = True
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWHEX = _DIGIT.copy()
_LOWHEX[97:103] = True
# two counters in one number: digits and upper-case letters, lower-case letters and hex digits
_ONE = _DIGIT + (_UPPER.astype(np.int64) << 32)
_TWO = _LOWER + (_LOWHEX.astype(np.int64) << 32)


def base_spans(text: str) -> list[tuple[int, int, int, int]]:
    """(start, kind, end, start of the value), sorted."""
    low = text.encode("utf-8", "replace").lower()
    out = []
    if any(k in low for k in NAMES):
        out += [(m.start(), 0, m.end(), m.start(2)) for m in ASSIGN.finditer(text) if len(m.group(2)) >= 12]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end(), m.start()) for m in ACCESS.finditer(text) if len(m.group()) >= 18]
    out += [(m.start(), 2, m.end(), m.start()) for m in HEX.finditer(text)]
    return sorted(out)


def tokens(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs without white space."""
    word = np.concatenate(([False], ~_SPACE[raw], [False]))
    edge = np.flatnonzero(word[1:] != word[:-1])
    return edge[::2], edge[1::2]


def codes(data: bytes, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    n = ends - starts
    one, two = np.add.reduceat(_ONE[raw], starts), np.add.reduceat(_TWO[raw], starts)
    digits, upper, lower, lowhex = one & 0xFFFFFFFF, one >> 32, two & 0xFFFFFFFF, two >> 32
    kind = _DIGIT[raw].astype(np.int8) - (_UPPER[raw] | _LOWER[raw])
    change = np.zeros(len(raw), dtype=np.int32)
    change[1:] = (kind[1:] * kind[:-1]) < 0
    changes = np.add.reduceat(change, starts)
    first, last = raw[starts], raw[ends - 1]
    letters = upper + lower
    quoted = np.isin(first, (34, 39, 96)) | np.isin(last, (34, 39, 96))
    core = digits + letters
    signs = (n - core - quoted - np.isin(last, (34, 39, 44, 46, 59, 96))) > 0
    shape = (n >= 12) & (digits > 0) & (2 * core > n)
    assigns = np.isin(last, (58, 61))
    before = np.zeros(len(n), dtype=bool)
    before[1:] = assigns[:-1]
    low = data.lower()
    named = np.zeros(len(n), dtype=bool)
    for k in KEYWORDS:
        at = low.find(k)
        while at >= 0:
            named[np.searchsorted(starts, at, side="right") - 1] = True
            at = low.find(k, at + len(k))
    near = named.copy()
    near[1:] |= named[:-1]
    near[2:] |= named[:-2]
    after = np.zeros(len(n), dtype=bool)
    after[:-1] = shape[1:]
    fields = (
        np.digitize(n, (8, 12, 16, 24, 40)), np.where(digits == 0, 0, np.where(2 * digits < n, 1, 2)),
        np.where(letters == 0, 0, np.where((upper > 0) & (lower > 0) & (upper > 1), 2, 1)), (lowhex >= 12) & (lowhex == core),
        np.digitize(changes, (1, 4)), quoted, signs, before, near, after,
        np.full(len(n), named.any()), np.full(len(n), digits.sum() * 20 > len(raw)),
    )
    out = np.zeros(len(n), dtype=np.int64)
    for size, f in zip(FIELDS, fields):
        out = out * size + f.astype(np.int64)
    return out


def one_hot(code: np.ndarray) -> np.ndarray:
    """Columns of the weight matrix that a code switches on, one per field."""
    cols = []
    at = sum(FIELDS)
    for size in reversed(FIELDS):
        at -= size
        cols.append(at + code % size)
        code = code // size
    return np.stack(cols, axis=-1)


class Model:
    def __init__(self, weights: np.ndarray, moves: np.ndarray):
        self.moves = moves
        self.scores = weights[one_hot(np.arange(int(np.prod(FIELDS))))].sum(axis=1)
        slack = 2 * (moves.max() - moves.min())
        self.outside = self.scores[:, 0] - self.scores[:, 1:].max(axis=1) > slack

    def tag(self, code: np.ndarray) -> list[tuple[int, int]]:
        """Spans of tokens (first, last) of the best path; both ends of the text are next to O."""
        open_ = np.flatnonzero(~self.outside[code])
        if not len(open_):
            return []
        spans = []
        for part in np.split(open_, np.flatnonzero(np.diff(open_) > 1) + 1):
            labels = viterbi(self.scores[code[part]], self.moves)
            for at, label in zip(part, labels):
                if label == 2 and spans and spans[-1][1] == at - 1:
                    spans[-1] = (spans[-1][0], int(at))
                elif label:
                    spans.append((int(at), int(at)))
        return spans


def viterbi(scores: np.ndarray, moves: np.ndarray) -> list[int]:
    """Best labels of a stretch between two tokens that are O."""
    best, back = moves[0] + scores[0], []
    for s in scores[1:]:
        ways = best[:, None] + moves
        back.append(ways.argmax(axis=0))
        best = ways.max(axis=0) + s
    label = int((best + moves[:, 0]).argmax())
    out = [label]
    for b in reversed(back):
        label = int(b[label])
        out.append(label)
    return out[::-1]


def _logsum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)


def fit(windows: list[tuple[list[int], list[int]]]) -> Model:
    """Weights from windows of (codes, labels); windows end next to O, as stretches do."""
    length = max(len(c) for c, _ in windows)
    size = len(windows)
    code, label, there = np.zeros((size, length), dtype=np.int64), np.zeros((size, length), dtype=np.int64), np.zeros((size, length), dtype=bool)
    for i, (c, y) in enumerate(windows):
        code[i, : len(c)], label[i, : len(c)], there[i, : len(c)] = c, y, True
    hot = one_hot(code)
    weights, moves = np.zeros((sum(FIELDS), 3)), np.zeros((3, 3))
    flat = hot[there].ravel()

    def by_column(share):
        return np.stack([np.bincount(flat, np.repeat(share[..., y][there], hot.shape[2]), len(weights)) for y in range(3)], axis=1)

    seen = by_column(np.eye(3)[label])
    steps = np.zeros((3, 3))
    ends = there.sum(axis=1) - 1
    np.add.at(steps, (np.zeros(size, dtype=int), label[:, 0]), 1.0)
    for t in range(1, length):
        on = there[:, t]
        np.add.at(steps, (label[on, t - 1], label[on, t]), 1.0)
    np.add.at(steps, (label[np.arange(size), ends], np.zeros(size, dtype=int)), 1.0)
    state = [(x, np.zeros_like(x), np.zeros_like(x)) for x in (weights, moves)]
    for step in range(1, STEPS + 1):
        score = sum(weights[hot[..., f]] for f in range(hot.shape[2]))
        forward = np.zeros((size, length, 3))
        backward = np.zeros((size, length, 3))
        forward[:, 0] = moves[0] + score[:, 0]
        for t in range(1, length):
            forward[:, t] = _logsum(forward[:, t - 1, :, None] + moves, 1) + score[:, t]
        for t in range(length - 1, -1, -1):
            last = (ends == t)[:, None]
            if t + 1 < length:
                backward[:, t] = _logsum(moves + (score[:, t + 1] + backward[:, t + 1])[:, None, :], 2)
            backward[:, t] = np.where(last, moves[:, 0], backward[:, t])
        total = _logsum(forward[:, 0] + backward[:, 0], 1)
        share = np.exp(forward + backward - total[:, None, None]) * there[:, :, None]
        expected = by_column(share)
        moved = np.zeros((3, 3))
        moved[0] += share[:, 0].sum(axis=0)
        for t in range(1, length):
            pair = np.exp(forward[:, t - 1, :, None] + moves + (score[:, t] + backward[:, t])[:, None, :] - total[:, None, None])
            moved += pair[there[:, t]].sum(axis=0)
        moved[:, 0] += share[np.arange(size), ends].sum(axis=0)
        for (x, mean, square), grad in zip(state, ((seen - expected) / size, (steps - moved) / size)):
            grad = grad - PENALTY * x
            mean += 0.1 * (grad - mean)
            square += 0.001 * (grad**2 - square)
            x += RATE * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.999**step)) + 1e-8)
    return Model(weights, moves)


def _prepared(text: str) -> tuple:
    data = text.encode("utf-8", "replace")
    raw = np.frombuffer(data, dtype=np.uint8)
    starts, ends = tokens(raw)
    return data, starts, ends, codes(data, raw, starts, ends) if len(starts) else starts


def _places(data: bytes, spans: list) -> list:
    """Byte offsets of code points, for a few sorted offsets, in one pass."""
    out, at, point = {}, 0, 0
    for x in sorted({x for s in spans for x in s}):
        point += len(data[at:x].decode("utf-8"))
        out[x], at = point, x
    return [tuple(out[x] for x in s) for s in spans]


def windows(text: str) -> list[tuple[list[int], list[int]]]:
    """Training windows of one document."""
    data, starts, ends, code = _prepared(text)
    if not len(starts):
        return []
    label = np.zeros(len(starts), dtype=np.int64)
    spans = base_spans(text)
    for _, _, end, value in spans:
        first = np.searchsorted(starts, len(text[:value].encode("utf-8", "replace")), side="right") - 1
        last = np.searchsorted(starts, len(text[: end - 1].encode("utf-8", "replace")), side="right") - 1
        label[first : last + 1] = np.where(label[first : last + 1] == 0, 2, label[first : last + 1])
        label[first] = 1
    middles = sorted({int(x) for x in np.flatnonzero(label)} | {len(code) // 2})
    out, done = [], -1
    for m in middles:
        a, b = max(0, m - WINDOW, done), min(len(code), m + WINDOW)
        if a < b and m >= done:
            while b < len(code) and label[b]:
                b += 1
            out.append((code[a:b].tolist(), label[a:b].tolist()))
            done = b
    return [w for w in out if len(w[0]) <= 4 * WINDOW]


def learn(docs: DataFrame) -> Model | None:
    """A model from a bounded sample; None if no document has a base span."""
    hits = checkpointed(docs.where("doc_id is not null and text is not null").select("doc_id", "text").mapInArrow(_hits, "doc_id long, hit boolean"))
    sizes = {r["hit"]: r["count"] for r in hits.groupBy("hit").count().collect()}
    if True not in sizes:
        return None
    u = F.pmod(F.xxhash64(F.lit(11), "doc_id"), F.lit(1_000_000))
    share = F.when(F.col("hit"), TRAIN_DOCS / sizes[True]).otherwise(TRAIN_DOCS / sizes.get(False, 1))
    few = hits.where(u < share * 1_000_000).orderBy(u, "doc_id").limit(2 * TRAIN_DOCS).select(F.col("doc_id").alias("id"))
    # 2 * TRAIN_DOCS rows at most, so the broadcast is bounded
    texts = docs.select("doc_id", "text").join(F.broadcast(few), F.col("doc_id") == F.col("id"), "left_semi")
    sample = texts.mapInArrow(_windows, "doc_id long, codes array<long>, labels array<long>").collect()
    found = [(r["codes"], r["labels"]) for r in sorted(sample, key=lambda r: (r["doc_id"], r["codes"], r["labels"]))]
    return fit(found) if any(any(y) for _, y in found) else None


def _hits(batches):
    for b in batches:
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array([bool(base_spans(t.as_py())) for t in b.column(1)], pa.bool_())], ["doc_id", "hit"])


def _windows(batches):
    for b in batches:
        rows = [(i.as_py(), c, y) for i, t in zip(b.column(0), b.column(1)) for c, y in windows(t.as_py() or "")[:8]]
        cols = list(zip(*rows)) or [(), (), ()]
        yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), *(pa.array(c, pa.list_(pa.int64())) for c in cols[1:])], ["doc_id", "codes", "labels"])


_STRIP = b"\"'`,;:()[]{}<>"


def find(text: str, model: Model | None) -> tuple[list, list]:
    """Base spans (start, kind, end, value) and added spans (start, end), in code points."""
    base = base_spans(text)
    if model is None:
        return base, []
    data, starts, ends, code = _prepared(text)
    spans = []
    for first, last in model.tag(code):
        a, b = int(starts[first]), int(ends[last])
        a += len(data[a:b]) - len(data[a:b].lstrip(_STRIP))
        b -= len(data[a:b]) - len(data[a:b].rstrip(_STRIP + b"."))
        if a < b:
            spans.append((a, b))
    extra = [(s, e) for s, e in _places(data, spans) if not any(a < e and s < b for a, _, b, _ in base)]
    return base, extra


def _find(model: Model | None):
    def run(batches):
        for batch in batches:
            rows = []
            for text in batch.column(1):
                base, extra = find(text.as_py() or "", model)
                names = [(s, k, f"{KINDS[k]}:{s}:{e}") for s, k, e, _ in base]
                every = sorted(names + [(s, len(KINDS), f"crf:{s}:{e}") for s, e in extra])
                joined = ",".join(x for _, _, x in names)
                rows.append((*(sum(k == i for _, k, _ in names) for i in range(3)), hashlib.sha256(joined.encode()).hexdigest(), ",".join(x for _, _, x in every)))
            cols = list(zip(*rows)) or [()] * 5
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, pa.int64()) for c in cols[:3]), *(pa.array(c, pa.string()) for c in cols[3:])],
                ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"],
            )

    return run


def find_secrets(docs: DataFrame, train: DataFrame | None = None) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans of `docs` (doc_id, text); the model is
    learned from `train`, or from `docs` themselves."""
    return docs.select("doc_id", "text").mapInArrow(
        _find(learn(docs if train is None else train)), "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"
    )
