"""Secrets in texts: three fixed patterns, and a character convolutional network over every further candidate.

Findings of the patterns always stand. Further candidates are what a key or password may look like: long runs of
key characters, and shorter words of digits, letters and signs together (``further_candidates``). The network reads a
candidate with its surroundings, a long one in overlapping windows to its end, and adds those it scores at or above its
threshold. It is trained on labelled windows: the patterns' findings, and keys and passwords of other shapes that are drawn
and planted where a word stood, against runs that look alike but are words, numbers, dates, addresses and names. Each is seen
with its surroundings, with those nearest to it blanked, and alone, so that it learns the key and not only the words
before it. A third of the labelled windows is held out; on these the scores are calibrated (Platt), and the threshold is the
highest that keeps the wanted recall.
"""

from __future__ import annotations

import hashlib
import math
import re
import string
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rootspan.llm.common import bounded, column, hash_sample, mapped
from rootspan.scratch import materialize

#: Fixed by contract.
ASSIGN = re.compile(rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I)
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
ASSIGN_CHARS, ACCESS_CHARS, HEX_CHARS = 12, 18, 16
KINDS = ("assign", "access", "hex", "key")

#: Labelled windows the network is trained on at most, its window, and the recall its threshold must keep.
TRAIN_WINDOWS, WINDOW, RECALL = 6000, 96, 0.98
#: Least characters of key-like runs, of those of letters alone, of pieces between slashes, and of passwords.
CANDIDATE_CHARS, LETTER_CHARS, PIECE_CHARS, PASSWORD_CHARS = 20, 28, 16, 8
#: No threshold lies below this, whatever is held out: a score of 0 tells nothing.
LEAST_CHANCE = 1e-6

_HEX = np.zeros(256, dtype=bool)
_HEX[list(b"0123456789abcdef")] = True
_KEY = np.zeros(256, dtype=bool)
_KEY[list(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-")] = True
_PASSWORD = re.compile(rb"[!-~]{%d,64}" % PASSWORD_CHARS)
#: Numbers, dates, times, versions, and words with a number after a mark: of digits and signs, or letters and digits in order.
_PLAIN = re.compile(rb"[0-9.,:/+TZ-]+|v?[0-9]+(?:\.[0-9]+)+[a-z]*|[A-Za-z]+(?:[-_.:/#|][A-Za-z]+)*[-_.:/#|]?[0-9]+|.*://.*|[^@]+@[^@]+\.[a-z]+", re.S)
_EDGES = b"\"'`()[]{}<>.,;:!?"
_DIGIT = np.zeros(256, dtype=bool)
_DIGIT[list(b"0123456789")] = True
#: Small alphabet of the network: blank 0, lower case by letter, upper case, digits, and marks by kind.
_CLASS = np.full(256, 34, dtype=np.int64)
for _i, _c in enumerate(b"abcdefghijklmnopqrstuvwxyz"):
    _CLASS[_c] = 1 + _i
for _codes, _n in ((b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", 27), (b"0123456789", 28), (b" \t\r\n", 29), (b"\"'`", 30), (b"=:", 31), (b"+/_-", 32), (b".,;!?()", 33)):
    _CLASS[list(_codes)] = _n
CLASSES = 36


def _runs(mask: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of at least ``least`` set places."""
    edges = np.diff(mask.view(np.int8), prepend=0, append=0)
    starts, ends = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    keep = ends - starts >= least
    return starts[keep], ends[keep]


def base_findings(data: bytes) -> list[tuple[int, int, int]]:
    """(start, kind, end) in bytes, by start and then kind."""
    low = data.lower()
    found = []
    if b"passw" in low or b"secret" in low or b"token" in low or b"api" in low:
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(data) if len(m[2]) >= ASSIGN_CHARS]
    if b"AKIA" in data:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(data) if len(m[0]) >= ACCESS_CHARS]
    starts, ends = _runs(_HEX[np.frombuffer(data, dtype=np.uint8)], HEX_CHARS)
    found += [(int(a), 2, int(b)) for a, b in zip(starts, ends)]
    return sorted(found)


def further_candidates(data: bytes, found: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """What else may be a secret and reaches beyond what is found, by start; of candidates that overlap, callers keep the likeliest.

    Runs of at least ``CANDIDATE_CHARS`` key characters with a letter and a digit, or of ``LETTER_CHARS`` letters (both as a
    whole and, where slashes cut them, piece by piece; in a web address by piece only); and words of at least
    ``PASSWORD_CHARS`` printable characters with a digit and two of small letters, capitals and signs.
    """
    raw = np.frombuffer(data, dtype=np.uint8)
    digits = np.concatenate([[0], np.cumsum(_DIGIT[raw])])
    out: set[tuple[int, int]] = set()

    def key_like(a: int, b: int, least: int) -> bool:
        n = int(digits[b] - digits[a])
        return b - a >= least and 0 < n < b - a or n == 0 and b - a >= LETTER_CHARS and data[a:b].isalpha()

    starts, ends = _runs(_KEY[raw], PIECE_CHARS)
    for a, b in zip(starts.tolist(), ends.tolist()):
        cuts = [i for i in range(a, b) if data[i] == 47] if b - a < 4096 and b"/" in data[a:b] else []
        if not cuts or b"://" not in data[max(0, a - 256) : b].split()[-1]:
            if key_like(a, b, CANDIDATE_CHARS):
                out.add((a, b))
        for x, y in zip([a, *(c + 1 for c in cuts)], [*cuts, b]) if cuts else ():
            if key_like(x, y, PIECE_CHARS):
                out.add((x, y))
    if digits[-1]:
        for m in _PASSWORD.finditer(data):
            a, b = m.span()
            if digits[b] == digits[a] or b - a == 64:
                continue
            word = m[0]
            left = len(word) - len(word.lstrip(_EDGES[:9]))
            right = len(word.rstrip(_EDGES))
            word = word[left:right]
            kinds = (word.lower() != word) + (word.upper() != word) + (not word.isalnum())
            if len(word) >= PASSWORD_CHARS and kinds >= 2 and digits[a + right] > digits[a + left] and not _PLAIN.fullmatch(word):
                out.add((a + left, a + right))
    def beyond(a: int, b: int) -> bool:
        """Whether at least four letters or digits lie outside of what is found."""
        near = [(max(a, s), min(b, e)) for s, _, e in found if s < b and a < e]
        return not near or sum(c < 128 and chr(c).isalnum() and not any(s <= i < e for s, e in near) for i, c in enumerate(data[a:b], a)) >= 4

    return sorted((a, 3, b) for a, b in out if beyond(a, b))


def lookalikes(data: bytes) -> list[tuple[int, int]]:
    """Runs that resemble keys by length alone: words without digits, numbers without letters."""
    raw = np.frombuffer(data, dtype=np.uint8)
    starts, ends = _runs(_KEY[raw], 10)
    digits = np.concatenate([[0], np.cumsum(_DIGIT[raw])])
    return [(a, b) for a, b in zip(starts.tolist(), ends.tolist()) if digits[b] - digits[a] in (0, b - a)]


def window(data: bytes, start: int, end: int, width: int = WINDOW, hide: int = 0) -> np.ndarray:
    """Classes of the candidate's characters with what stands around, the candidate in the middle; ``hide`` blanks so many places on both sides."""
    middle = (start + end) // 2
    a, b = middle - width // 2, middle + width // 2
    out = np.zeros(width, dtype=np.int64)
    lo, hi = max(a, 0), min(b, len(data))
    out[lo - a : hi - a] = _CLASS[np.frombuffer(data[lo:hi], dtype=np.uint8)]
    out[max(0, start - a - hide) : max(0, start - a)] = 0
    out[max(0, end - a) : max(0, end - a) + hide] = 0
    return out


def windows(data: bytes, start: int, end: int, width: int = WINDOW) -> list[np.ndarray]:
    """One window, or for a candidate of more than two thirds of it overlapping ones from its start to its end, with surroundings on both sides."""
    part = 2 * width // 3
    if end - start <= part:
        return [window(data, start, end, width)]
    places = [*range(start, end - part, part // 2), end - part]
    return [window(data, at, at + part, width) for at in places]


@dataclass
class Network:
    """Embedding, one convolution, maximum and mean over places, one output; then Platt's scale and the threshold."""

    table: np.ndarray
    kernel: np.ndarray
    bias: np.ndarray
    out: np.ndarray
    out_bias: float
    slope: float = 1.0
    shift: float = 0.0
    threshold: float = 0.5

    @classmethod
    def new(cls, seed: int, dims: int = 10, span: int = 5, filters: int = 24) -> Network:
        rng = np.random.default_rng(seed)
        return cls(rng.normal(0, 0.3, (CLASSES, dims)), rng.normal(0, 0.25, (span * dims, filters)), np.zeros(filters), rng.normal(0, 0.2, 2 * filters), 0.0)

    def parts(self, x: np.ndarray):
        span = len(self.kernel) // self.table.shape[1]
        seen = self.table[x]
        cols = np.concatenate([seen[:, i : x.shape[1] - span + 1 + i] for i in range(span)], axis=2)
        act = np.maximum(cols @ self.kernel + self.bias, 0)
        return cols, act, np.concatenate([act.max(axis=1), act.mean(axis=1)], axis=1)

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.concatenate([self.parts(x[i : i + 512])[2] @ self.out + self.out_bias for i in range(0, len(x), 512)]) if len(x) else np.zeros(0)

    def chance(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.logits(x) + self.shift, -40, 40)))

    def step(self, x: np.ndarray, y: np.ndarray, memory: dict[str, np.ndarray], rate: float) -> None:
        """One step of Adam on a batch's cross entropy."""
        cols, act, pooled = self.parts(x)
        error = (1 / (1 + np.exp(-np.clip(pooled @ self.out + self.out_bias, -40, 40))) - y) / len(y)
        places, filters = act.shape[1], act.shape[2]
        back = np.outer(error, self.out)
        top = np.arange(places)[None, :, None] == act.argmax(axis=1)[:, None, :]
        grad_act = (back[:, None, filters:] / places + top * back[:, None, :filters]) * (act > 0)
        grad_kernel = np.einsum("npc,npf->cf", cols, grad_act, optimize=True)
        grad_cols = grad_act @ self.kernel.T
        grad_table, dims = np.zeros_like(self.table), self.table.shape[1]
        for i in range(len(self.kernel) // dims):
            np.add.at(grad_table, x[:, i : i + places], grad_cols[:, :, i * dims : (i + 1) * dims])
        memory["t"] = memory.get("t", 0) + 1
        for name, grad in (("table", grad_table), ("kernel", grad_kernel), ("bias", grad_act.sum(axis=(0, 1))), ("out", pooled.T @ error), ("out_bias", error.sum())):
            m = memory[name + "1"] = 0.9 * memory.get(name + "1", 0) + 0.1 * grad
            v = memory[name + "2"] = 0.999 * memory.get(name + "2", 0) + 0.001 * grad**2
            setattr(self, name, getattr(self, name) - rate * (m / (1 - 0.9 ** memory["t"])) / (np.sqrt(v / (1 - 0.999 ** memory["t"])) + 1e-8))


def train(windows: np.ndarray, labels: np.ndarray, recall: float = RECALL, seen: int = 80_000, seed: int = 11) -> Network:
    """Fit on two thirds of the labelled windows, about ``seen`` of them with repeats, calibrate and set the threshold on the rest.

    With fewer than 20 of either label there is nothing to learn from: the threshold is then above 1
    and the network adds nothing.
    """
    net = Network.new(seed)
    if min(labels.sum(), len(labels) - labels.sum()) < 20:
        net.threshold = 2.0
        return net
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(labels))
    held, fit = order[: len(order) // 3], order[len(order) // 3 :]
    memory: dict = {}
    for _ in range(max(6, min(60, seen // len(fit)))):
        rng.shuffle(fit)
        for at in range(0, len(fit), 64):
            net.step(windows[fit[at : at + 64]], labels[fit[at : at + 64]].astype(float), memory, 0.004)
    logits, y = net.logits(windows[held]), labels[held].astype(float)
    slope, shift = 1.0, 0.0
    target = np.where(y > 0, (y.sum() + 1) / (y.sum() + 2), 1 / (len(y) - y.sum() + 2))
    for _ in range(50):  # Newton's method on Platt's two numbers
        p = 1 / (1 + np.exp(-np.clip(slope * logits + shift, -40, 40)))
        w = np.maximum(p * (1 - p), 1e-6)
        g = np.array([((p - target) * logits).sum() + 1e-3 * (slope - 1), (p - target).sum()])
        h = np.array([[(w * logits**2).sum() + 1e-3, (w * logits).sum()], [(w * logits).sum(), w.sum() + 1e-3]])
        move = np.clip(np.linalg.solve(h, g), -1, 1)
        slope, shift = slope - move[0], shift - move[1]
    net.slope, net.shift = float(slope), float(shift)
    chance = net.chance(windows[held])
    hits = np.sort(chance[y > 0])
    keeps_recall = float(hits[math.floor((1 - recall) * len(hits))])
    net.threshold = max(LEAST_CHANCE, keeps_recall)
    return net


def planted(seed: bytes, n: int = 2) -> list[bytes]:
    """Keys and passwords of other shapes than the patterns', drawn at random but alike for a seed."""
    rng = np.random.default_rng(int.from_bytes(hashlib.blake2b(seed, digest_size=8).digest(), "big"))
    letters, out = string.ascii_letters, []
    shapes = [(letters + string.digits, 20, 44), (letters + string.digits + "+/_-", 20, 64), (letters, 28, 48), (string.ascii_lowercase, 28, 40), (string.ascii_uppercase + string.digits, 20, 40)]
    for _ in range(n):
        kind = rng.integers(0, len(shapes) + 2)
        if kind < len(shapes):
            alphabet, low, high = shapes[kind]
            text = "".join(rng.choice(list(alphabet), rng.integers(low, high)))
        else:
            text = "".join(rng.choice(list(letters + string.digits + "!@#$%^&*"), rng.integers(8, 17)))
            text = text[:-3] + rng.choice(list(string.digits)) + rng.choice(list("!@#$%^&*")) + rng.choice(list(letters))
        out.append(text.encode())
    return out


def plain_runs(seed: bytes, word: bytes) -> list[bytes]:
    """What looks like a key but is none: a name with a number, a date, an identifier, a path, a marked or doubled word."""
    rng = np.random.default_rng(int.from_bytes(hashlib.blake2b(seed + word, digest_size=8).digest(), "big"))
    n, hexes = rng.integers(0, 10_000), "".join(rng.choice(list("0123456789abcdef"), 32))
    shapes = [word * 3 + b"%d" % n, word.capitalize() * 2, b"20%02d-%02d-%02dT10:00:00Z" % (n % 100, n % 12 + 1, n % 28 + 1), f"{hexes[:8]}-{hexes[8:12]}-{hexes[12:16]}-{hexes[16:20]}-{hexes[20:]}".encode(), word + b"/" + word + b"/index%d.html" % n, word + b"_" + word.upper() + b"_%d" % n, word + b"-%d" % n + b"%" * 3]
    return [shapes[i] for i in rng.choice(len(shapes), 2, replace=False)]


def _labelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Windows of findings and of as many lookalikes of the same text, each with a key that orders them at random but alike in every run."""
    for batch in bounded(batches, "text"):
        keys, labels, windows = [], [], []
        for data in column(batch, "text").to_pylist():
            data = data or b""
            found = base_findings(data)
            if not found:
                continue
            others = [(a, b) for a, b in lookalikes(data) if not any(a < e and s < b for s, _, e in found)]
            picked = {hashlib.blake2b(b"%d:" % a + data[a:b], digest_size=8).digest(): (a, b) for a, b in others}
            chosen = [(a, b, False) for _, (a, b) in sorted(picked.items())[: 2 * len(found)]]
            values = [(ASSIGN.match(data, a).start(2) if k == 0 else a, b, not data[a:b].isdigit()) for a, k, b in found]
            seen = [(data, a, b, label, hide) for a, b, label in values + chosen for hide in (0, 12, WINDOW)]
            for n, (a, b, label) in enumerate(values):  # the same key where a word stood, whole and shorter
                for s, e, _ in chosen[2 * n : 2 * n + 2]:
                    near = max(0, s - WINDOW)
                    for size in {b - a, CANDIDATE_CHARS + (s + e) % max(1, b - a - CANDIDATE_CHARS), CANDIDATE_CHARS}:
                        key = data[a:b][:size]
                        seen.append((data[near:s] + key + data[e : e + WINDOW], s - near, s - near + len(key), label, 0))
                    seed = b"%d" % s + data[s:e]
                    for key, own in [(k, True) for k in planted(seed)] + [(k, False) for k in plain_runs(seed, data[s:e])]:
                        hide = (0, 12, WINDOW)[len(seen) % 3]
                        seen.append((data[near:s] + key + data[e : e + WINDOW], s - near, s - near + len(key), own, hide))
            for text, a, b, label, hide in seen:
                got = window(text, a, min(b, a + 2 * WINDOW // 3), hide=hide).astype(np.uint8).tobytes()
                keys.append(int.from_bytes(hashlib.blake2b(got + b"%d" % a, digest_size=8).digest(), "big", signed=True))
                labels.append(label)
                windows.append(got)
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(labels, pa.bool_()), pa.array(windows, pa.binary())], ["key", "label", "window"])


def fit_network(docs: DataFrame, limit: int = TRAIN_WINDOWS, recall: float = RECALL) -> Network:
    """A network from at most ``limit`` labelled windows of ``docs``, half of each label, chosen by hash over all documents; windows that copies repeat count once."""
    texts = docs.select(F.col("text").cast("binary").alias("text"))
    labelled = materialize(mapped(texts, _labelled, "key long, label boolean, window binary").distinct(), "windows")
    counts = {r["label"]: r["n"] for r in labelled.groupBy("label").agg(F.count("*").alias("n")).collect()}
    rows = [r for label in (True, False) for r in hash_sample(labelled.where(F.col("label") == label), "key", limit // 2, counts.get(label, 0)).collect()]
    x = np.array([np.frombuffer(bytes(r["window"]), dtype=np.uint8) for r in rows], dtype=np.int64).reshape(-1, WINDOW)
    return train(x, np.array([r["label"] for r in rows], dtype=bool), recall)


def all_findings(data: bytes, net: Network) -> list[tuple[int, int, int]]:
    """Findings of the patterns, and of overlapping candidates at or above the threshold the likeliest (then the longest, then the first)."""
    found = base_findings(data)
    more = further_candidates(data, found) if net.threshold <= 1 else []
    if not more:
        return found
    views = [windows(data, a, b) for a, _, b in more]
    chance = net.chance(np.array([w for v in views for w in v]))
    best = np.maximum.reduceat(chance, np.cumsum([0, *(len(v) for v in views[:-1])]))
    taken: list[tuple[int, int, int]] = []
    for p, c in sorted(((p, c) for p, c in zip(best.tolist(), more) if p >= net.threshold), key=lambda x: (-x[0], x[1][0] - x[1][2], x[1])):
        if not any(c[0] < e and s < c[2] for s, _, e in taken):
            taken.append(c)
    return sorted(found + taken)


def in_code_points(data: bytes, found: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """The same spans counted in code points; one pass over the text."""
    if not found or data.isascii():
        return found
    heads = np.concatenate([[0], np.cumsum((np.frombuffer(data, dtype=np.uint8) & 0xC0) != 0x80)])
    return [(int(heads[s]), k, int(heads[e])) for s, k, e in found]


def _scan(net: Network):
    def line(found: list[tuple[int, int, int]]) -> str:
        return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in found)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches, "text"):
            out: list[list] = [[] for _ in range(5)]
            for data in column(batch, "text").to_pylist():
                data = data or b""
                found = in_code_points(data, all_findings(data, net))
                base = [f for f in found if f[1] < 3]
                for to, x in zip(out, [*(sum(f[1] == k for f in base) for k in range(3)), hashlib.sha256(line(base).encode()).hexdigest(), line(found)]):
                    to.append(x)
            arrays = [pa.array(x, t) for x, t in zip(out, [pa.int64()] * 3 + [pa.string()] * 2)]
            yield pa.RecordBatch.from_arrays([column(batch, "doc_id"), *arrays], ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    return run


def scan_secrets(docs: DataFrame, net: Network | None = None) -> DataFrame:
    """``doc_id, n_assign, n_access, n_hex, base_sha256, spans`` for every row of ``docs``; no shuffle.

    net: a fitted network; None fits one on ``docs``. A null or empty text has no findings (the
    digest is that of the empty string). Null and repeated doc_ids keep their rows, other columns are
    not read, texts are read whole at any length. Empty in, empty out.
    """
    net = net or fit_network(docs)
    kept = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return mapped(kept, _scan(net), "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def _masked(net: Network, mark: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches, "text"):
            texts, sizes = [], []
            for data in column(batch, "text").cast(pa.binary()).to_pylist():
                if data is not None:
                    parts, at = [], 0
                    for s, k, e in all_findings(data, net):
                        if k == 0:  # the name before the value stays
                            s = ASSIGN.match(data, s).start(2)
                        if e > at:
                            parts += [data[at : max(s, at)], mark] if s >= at else []
                            at = e
                    data = b"".join([*parts, data[at:]]).decode("utf-8", "replace")
                texts.append(data)
                sizes.append(None if data is None else len(data))
            out = {name: column(batch, name) for name in batch.schema.names} | {"text": pa.array(texts, pa.string())}
            if "n_chars" in out:
                out["n_chars"] = pa.array(sizes, out["n_chars"].type)
            yield pa.RecordBatch.from_arrays(list(out.values()), list(out))

    return run


def mask_secrets(docs: DataFrame, net: Network | None = None, mark: str = "<secret>") -> DataFrame:
    """``docs`` with every finding's value replaced by ``mark``, and n_chars, where there is one, brought up to date.

    Overlapping findings become one mark. Null texts stay null, texts without findings as they are, but for bytes that are no
    UTF-8, which become U+FFFD. Repeated rows, null ids and columns of any other name pass through. Empty in, empty out.
    """
    net = net or fit_network(docs)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return mapped(docs, _masked(net, mark.encode()), schema)
