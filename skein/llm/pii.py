"""Personal data: high-recall candidate spans, boosted trees over format and context, calibrated redaction.

Four base kinds have exact rules and always stay. Beside them, loose generators propose overlapping spans (addresses written
out, telephone numbers without a plus sign, long digit groups, key = "value" pairs). Boosted regression trees, fitted here with
numpy on the candidates of all documents, score each span by its format and its surroundings; scores are
calibrated on spans kept from the fit, and a span is added where its probability reaches the threshold of its kind whose
calibration precision on spans outside the base rules is at least ``PRECISION``. Labels of the fit come from checks the features do not see: the base rules, assignments of
a random-looking value to a name, a loose address that decodes to a base one, a valid grouping of digits after a telephone word.
Rows of equal bins are one row with a weight; the sums of a level
are counted by the tasks that hold the rows, in whole numbers, so they do not depend on partitions, and scores are rounded so that
calibration needs their counts only. As a table may hold no loose address or number at all, the texts are also read with some written in (``planted``): base
numbers without their plus sign and prefix and base addresses spelled out are right ones, dates, versions and dotted numbers in the
same surroundings wrong ones.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator
import hashlib
from itertools import accumulate
import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from skein.llm.common import partitions, ready
from skein.session import stage

PRECISION = 0.98
TREES, DEPTH, RATE, BINS = 40, 3, 0.2, 32
UNIT = 1 << 20           # gradients are added up as whole numbers of this fraction
DIGITS = 3               # of a score
LOCAL_ROWS = 50_000      # up to as many different rows the sums of a level are counted here, beyond by a job, with equal sums
# The base kinds in the order in which they are listed, then the kind of the method's own.
KINDS = ["email", "ip", "card", "phone", "secret"]
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DOTTED = re.compile(r"[0-9][0-9.]*")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_RUN = r"[A-Za-z0-9+/_=-][A-Za-z0-9+/_=.-]{14,}[A-Za-z0-9+/_=-]"  # a value of any length, with dots inside
_LOOSE = [
    ("email", re.compile(r"[A-Za-z0-9._%+-]{1,64} ?[\[(](?:at|@)[\])] ?[A-Za-z0-9-]{1,63}(?: ?(?:\.|[\[(]dot[\])]) ?[A-Za-z0-9-]{1,63}){1,4}")),
    ("phone", re.compile(r"(?<![0-9+])(?:\([0-9]{2,4}\)|[0-9]{2,4})[ .-][0-9]{2,4}[ .-][0-9]{3,6}(?![0-9])")),
    ("secret", re.compile(rf"""[A-Za-z_]{{2,30}} ?[=:] ?["']?{_RUN}["']?""")),
]
_VALUE = re.compile(rf"""[=:] ?["']?({_RUN})""")
_CALL = re.compile(r"(?i)\b(?:tel|phone|telephone|telefon|call|fax|mobile|cell)\b")
_AT = re.compile(r" ?[\[(](?:at|@)[\])] ?")
_DOT = re.compile(r" ?[\[(]dot[\])] ?| ?\. ?")
_NAMED = re.compile(r"(?i)token|key|secret|passw|pwd|auth|credential")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost addresses; works outward from each @, so long runs of name characters cost nothing extra."""
    found, free, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in LOCAL:
            start -= 1
        match = _DOMAIN.match(text, at + 1) if start < at else None
        if match:
            free = match.end()
            found.append((start, free))
        at = text.find("@", at + 1)
    return found


def ips(text: str) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """(addresses, dotted quads whose parts are too large); each run of dotted numbers is read four parts at a time."""
    good, bad = [], []
    for run in _DOTTED.finditer(text):
        if run[0].count(".") < 3:
            continue
        parts, at = [], run.start()
        for part in run[0].split("."):
            parts = [*parts, (at, at + len(part))] if part else []
            at += len(part) + 1
            if len(parts) == 4:
                fits = all(len(text[a:b].lstrip("0")) <= 3 and int(text[a:b].lstrip("0") or "0") <= 255 for a, b in parts)
                (good if fits else bad).append((parts[0][0], parts[3][1]))
                parts = []
    return good, bad


def digits_of(text: str) -> str:
    return re.sub("[^0-9]", "", text)


def spans(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int, int]]]:
    """(base spans, candidates): base as (kind, start, end); candidates as (kind, start, end, label), base spans among them."""
    base: list[tuple[int, int, int]] = []
    other: list[tuple[int, int, int]] = []
    if "@" in text:
        base += [(0, a, b) for a, b in emails(text)]
    good, bad = ips(text)
    base += [(1, a, b) for a, b in good]
    other += [(1, a, b) for a, b in bad]
    for match in _CARD.finditer(text):
        n = match.end() - match.start()
        if n >= 12:
            digits = digits_of(match[0])
            (base if 16 <= len(digits) <= 19 and luhn(digits) else other).append((2, *match.span()))
    if "+" in text:
        for match in _PHONE.finditer(text):
            (base if 8 <= len(digits_of(match[0])) <= 15 else other).append((3, *match.span()))
    for kind, pattern in _LOOSE:
        if kind == "email" and "[" not in text and "(" not in text or kind == "secret" and "=" not in text and ":" not in text:
            continue
        other += [(KINDS.index(kind), *m.span()) for m in pattern.finditer(text)]
    base.sort()
    taken = sorted((a, b) for _, a, b in base)
    starts = [a for a, _ in taken]
    reach = list(accumulate((b for _, b in taken), max))  # the furthest end of the spans up to each
    candidates = [(k, a, b, 1) for k, a, b in base]
    for kind, a, b in other:
        before, touching = bisect_right(starts, a), bisect_left(starts, b)
        if before and reach[before - 1] >= b:
            continue  # inside a base span
        meets = touching and reach[touching - 1] > a
        candidates.append((kind, a, b, 0 if meets else label(text, kind, a, b)))
    return base, candidates


def label(text: str, kind: int, start: int, end: int) -> int:
    """1 and 0 for spans that checks of their own accept and refuse, -1 where they can't tell; those are left out of the fit."""
    span = text[start:end]
    if kind == 4:
        return int(random_looking(span))
    if kind == 0:
        return int(decodes(span))
    if kind == 3 and not span.startswith("+"):
        if not grouped(text, start, end):
            return 0
        return 1 if _CALL.search(text[max(0, start - 24):start]) else -1
    return 0


def decodes(span: str) -> bool:
    """A spelled-out address that is one base address when written with @ and dots, ending in a name of letters."""
    plain = _DOT.sub(".", _AT.sub("@", span, count=1))
    return emails(plain) == [(0, len(plain))] and plain.rsplit(".", 1)[1].isalpha() and len(plain.rsplit(".", 1)[1]) >= 2


def grouped(text: str, start: int, end: int) -> bool:
    """Nine to twelve digits in groups of a telephone number, not a part of a longer row of numbers."""
    sizes = [len(g) for g in re.findall("[0-9]+", text[start:end])]
    row = re.search(r"[0-9][.-]$", text[max(0, start - 2):start]) or re.match(r"[.-][0-9]", text[end:end + 2])
    return 9 <= sum(sizes) <= 12 and sizes[1] >= 3 and sizes[2] >= 3 and not row


def planted(text: str, base: list[tuple[int, int, int]]) -> list[tuple[str, int, int, int, int]]:
    """(text, kind, start, end, label): candidates written into the text where the ``base`` numbers and addresses stand, or anywhere."""
    seed = int(hashlib.md5(text.encode()).hexdigest(), 16)
    free = text.find(" ", seed % (len(text) + 1)) + 1
    out = []

    def put(kind: int, at: tuple[int, int], written: str, right: int) -> None:
        near, end = text[max(0, at[0] - 64):at[0]], text[at[1]:at[1] + 64]  # all that features and generators look at
        turn = int(hashlib.md5(f"{seed} {written}".encode()).hexdigest(), 16)
        near = [near, near, near, near + "(", ""][turn % 5]
        end = [end, end, "." + end, ", " + end, ") " + end, ".", ""][turn // 5 % 7]
        whole, first, last = near + written + end, len(near), len(near) + len(written)
        for k, a, b, _ in spans(whole)[1]:
            if k == kind and a < last and first < b and (not right or (a, b) == (first, last)):
                out.append((whole, k, a, b, right))

    at = [(a, b) for k, a, b in base if k == 3] or [(free, free)]
    a, b = at[seed % len(at)]
    digits = (digits_of(text[a:b]) + str(seed))[-10:] if a < b and len(digits_of(text[a:b])) >= 10 else str(seed)[:10]
    x, y, z = digits[:3], digits[3:6], digits[6:]
    right = [f"({x}) {y}-{z}", f"({x}) {y} {z}", f"{x}-{y}-{z}", f"{x} {y} {z}", f"{x}.{y}.{z}", f"0{x} {y} {z}", f"({x[:2]}) {y}{x[2]}-{z}",
             f"{x[:2]} {y}{x[2]} {z}", f"0{x[:2]}-{y}{x[2]}-{z}"]
    day, month, year = f"{1 + seed % 28:02}", f"{1 + seed // 28 % 12:02}", str(1950 + seed // 400 % 90)
    wrong = [f"{day}.{month}.{year}", f"{day}-{month}-{year}", f"{month} {day} {year}", f"{x[:2]}.{y[:2]}.{z}", f"{x[:2]}.{y[:2]}.{z[:3]}",
             f"{x}.{y}.{z[:3]}", f"{x} {y} {z[:3]}", f"{x}.{y}.{z}.{x[:2]}", f"{x[:2]}.{y}.{z}.{x}", f"{year}-{month}-{day}{z[:3]}",
             f"{x}.{y}.{z}.{y}.{x}", f"{x}-{y[:2]}-{z}-{y}", f"v{x[:2]}.{y[:2]}.{z}", f"{year} {int(year) + 1} {int(year) + 2}"]
    put(3, (a, b), right[seed // 7 % len(right)], 1)
    put(3, (a, b), right[seed // 77 % 5], 1)
    put(3, (a, b), wrong[seed // 11 % len(wrong)], 0)
    put(3, (a, b), wrong[seed // 1111 % len(wrong)], 0)
    at = [(a, b) for k, a, b in base if k == 0] or [(free, free)]
    a, b = at[seed % len(at)]
    name, host = text[a:b].split("@") if a < b else (f"n{seed % 97}.{'kmrst'[seed % 5]}", f"mail{seed % 7}.example.org")
    sign, dot = [(" [at] ", " [dot] "), ("(at)", "(dot)"), (" (at) ", "."), ("[@]", " [dot] "), (" [at] ", ".")][seed // 13 % 5]
    host = host if seed // 5 % 2 else ".".join(host.split(".")[-2:])
    for who in (name, re.sub("[^A-Za-z]", "", name) or "n"):
        loose = who + sign + host.replace(".", dot)
        put(0, (a, b), loose, int(decodes(loose)))
    name = re.sub("[^a-z]", "", name.lower()) or "n" if seed // 3 % 2 else name
    put(0, (a, b), f"{name}{sign}{x[:1 + seed % 3]}{dot}{y[:1 + seed // 2 % 3]}", 0)
    rough = "".join(hashlib.sha256(f"{seed} {i}".encode()).hexdigest() for i in range(8))
    value = rough[:[20, 32, 40, 64, 130, 500][seed % 6]]
    value = [value, value, value.upper(), f"{value[:12]}_{value[12:]}", f"{value[:9]}.{value[9:]}"][seed // 6 % 5]
    dull = ["settings_for_all_users", "5550123" * 3, "path/to/some/other/file", "a1" * 12][seed // 3 % 4]
    named, mark = ["token", "api_key", "secret", "password", "auth"][seed // 17 % 5], ['"', "", "'"][seed // 31 % 3]
    for before, held in ((named, value), (named, dull), (["name", "id", "file", "digest"][seed // 37 % 4], value)):
        written = f"{before}{[' = ', '=', ': '][seed // 41 % 3]}{mark}{held}{mark}"
        put(4, (free, free), written, int(random_looking(written)))
    return out


def random_looking(assignment: str) -> bool:
    """A named value that mixes letters and digits and hardly repeats."""
    value = _VALUE.search(assignment)
    if not value or not _NAMED.search(assignment[:value.start()]):
        return False
    text = value[1]
    return any(c.isdigit() for c in text) and any(c.isalpha() for c in text) and len(set(text)) >= 8


def features(text: str, kind: int, start: int, end: int) -> list[float]:
    """Format of the span and of what stands around it; neither the Luhn sum nor the limits of the base rules are looked at."""
    span, before, after = text[start:end], text[max(0, start - 24):start], text[end:end + 12]
    n = len(span)
    digits = sum(c.isdigit() for c in span)
    row = bool(re.search(r"[0-9][.-]$", before)) + 2 * bool(re.match(r"[.-][0-9]", after))
    loose = kind == 3 and not span.startswith("+")  # its label looks at telephone words
    letters = sum(c.isalpha() for c in span)
    groups = re.findall(r"[0-9]+", span)
    lowered = before.lower()
    return [kind, n, digits, digits / n, letters / n, len(groups), max(map(len, groups), default=0), min(map(len, groups), default=0),
            span.count("."), span.count("-"), span.count(" "), span.count("("), span.startswith("+"), "@" in span, "=" in span,
            '"' in span, len(set(span[:64])) / min(n, 64), float(bool(groups) and int(groups[0][:4]) > 255), before[-1:].isalnum(), after[:1].isalnum(),
            after[:1] in ".,;", "@" in after, bool(_NAMED.search(before) or _NAMED.search(span)), not loose and any(w in lowered for w in ("tel", "phone", "call", "fax")),
            any(w in lowered for w in ("card", "visa", "iban", "account")), sum(c.isdigit() for c in before), sum(c.isdigit() for c in after),
            row, *[len(g) for g in (groups + ["", "", ""])[:3]], span[-1:].isalpha()]


def quantiles() -> list[float]:
    return np.linspace(0, 1, BINS + 1)[1:-1].tolist()


def binned(x: np.ndarray, cuts: list[np.ndarray]) -> np.ndarray:
    return np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)], axis=1).astype(np.uint8)


def ends(columns: np.ndarray, tree: list[tuple]) -> np.ndarray:
    """The node of each row in a tree of (feature, cut, left, right, value); ``columns`` are rows of features, or of bins with trees that cut them."""
    def below(node: int) -> np.ndarray | int:
        feature, cut, left, right = tree[node][:4]
        return node if feature < 0 else np.where(columns[:, feature] <= cut, below(left), below(right))

    return np.broadcast_to(below(0), len(columns))


def level_sums(bins: np.ndarray, y: np.ndarray, w: np.ndarray, start: float, trees: list[list[tuple]], nodes: list[int]) -> np.ndarray:
    """(3, nodes, features, BINS) sums of gradient and hessian for the ``nodes`` of the last tree, which is still growing; ``bins`` by column.

    The third are the weights of the nodes, in the first slot of each.
    """
    raw = np.full(len(y), start)
    for tree in trees[:-1]:
        raw += np.array([n[4] for n in tree])[ends(bins, tree)]
    place = np.full(len(trees[-1]), -1)
    place[nodes] = np.arange(len(nodes))
    at = place[ends(bins, trees[-1])]
    p = 1 / (1 + np.exp(-raw))
    parts = (np.rint((y - p) * UNIT) * w, np.rint(p * (1 - p) * UNIT) * w)
    rows = at >= 0
    out = np.zeros((3, len(nodes), bins.shape[1], BINS), np.int64)
    out[2, :, 0, 0] = np.bincount(at[rows], w[rows], len(nodes))
    at, parts = at[rows] * BINS, [part[rows] for part in parts]
    for j in range(bins.shape[1]):
        slot = at + bins[rows, j]
        for k, part in enumerate(parts):
            out[k, :, j] = np.bincount(slot, part, len(nodes) * BINS).reshape(len(nodes), BINS)
    return out


class Boosted:
    """Gradient boosting of small regression trees on the logistic loss, on binned features."""

    def __init__(self, trees: int = TREES, depth: int = DEPTH, rate: float = RATE):
        self.trees, self.depth, self.rate = trees, depth, rate
        self.grown: list[list[tuple]] = []
        self.start = 0.0
        self.threshold = 1.1
        self.kinds: dict[int, float] = {}  # thresholds of spans that no base rule took, by kind
        self.scale = (1.0, 0.0)

    def fit(self, x: np.ndarray, y: np.ndarray) -> Boosted:
        cuts = [np.unique(np.quantile(x[:, j], quantiles())) for j in range(x.shape[1])]
        bins, ones = np.asfortranarray(binned(x, cuts)), np.ones(len(y))
        return self.grow(cuts, float(y.mean()), lambda *asked: level_sums(bins, y, ones, *asked))

    def grow(self, cuts: list[np.ndarray], share: float, sums: Callable[[float, list, list], np.ndarray]) -> Boosted:
        """Trees from the ``level_sums`` of all rows, asked for once a level: ``sums(start, trees of bins, nodes)``."""
        share = min(max(share, 1e-3), 1 - 1e-3)
        self.start = float(np.log(share / (1 - share)))
        trees: list[list[tuple]] = []
        for _ in range(self.trees):
            tree, nodes = [(-1, 0, 0, 0, 0.0)], [0]
            trees.append(tree)
            for _ in range(self.depth):
                if not nodes:
                    break
                found, opened = sums(self.start, trees, nodes), []
                for i, node in enumerate(nodes):
                    g, h = found[:2, i] / UNIT
                    whole_g, whole_h = g[0].sum(), h[0].sum()
                    if node == 0:
                        tree[0] = (-1, 0, 0, 0, self.rate * whole_g / (whole_h + 1.0))
                    gs, hs = np.cumsum(g, axis=1)[:, :-1], np.cumsum(h, axis=1)[:, :-1]
                    gain = gs ** 2 / (hs + 1.0) + (whole_g - gs) ** 2 / (whole_h - hs + 1.0) - whole_g ** 2 / (whole_h + 1.0)
                    gain[np.arange(BINS - 1) >= np.array([len(c) for c in cuts])[:, None]] = 0.0
                    j, at = divmod(int(gain.argmax()), BINS - 1)
                    if found[2, i, 0, 0] < 8 or gain[j, at] <= 1e-6:
                        continue
                    low = self.rate * gs[j, at] / (hs[j, at] + 1.0)
                    high = self.rate * (whole_g - gs[j, at]) / (whole_h - hs[j, at] + 1.0)
                    tree[node] = (j, at, len(tree), len(tree) + 1, tree[node][4])
                    opened += [len(tree), len(tree) + 1]
                    tree += [(-1, 0, 0, 0, float(low)), (-1, 0, 0, 0, float(high))]
                nodes = opened
        self.grown = [[(j, float(cuts[j][at]) if j >= 0 else 0.0, left, right, value) for j, at, left, right, value in tree] for tree in trees]
        return self

    def raw(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.start)
        for tree in self.grown:
            out += np.array([n[4] for n in tree])[ends(x, tree)]
        return np.round(out, DIGITS)

    def probability(self, x: np.ndarray) -> np.ndarray:
        return self._scaled(self.raw(x))

    def _scaled(self, z: np.ndarray) -> np.ndarray:
        a, b = self.scale
        return 1 / (1 + np.exp(-(a * z + b)))

    def calibrate(self, x: np.ndarray, y: np.ndarray, precision: float) -> None:
        self.calibrate_scores(self.raw(x), y, np.ones(len(y)), precision)

    def calibrate_scores(self, z: np.ndarray, y: np.ndarray, n: np.ndarray, precision: float) -> None:
        """Platt scaling by a few Newton steps, then the lowest threshold with the asked precision, for rows that come ``n`` times."""
        a, b = 1.0, 0.0
        for _ in range(20):
            p = 1 / (1 + np.exp(-(a * z + b)))
            w, r = n * (p * (1 - p) + 1e-9), n * (y - p)
            hessian = np.array([[(w * z * z).sum() + 1e-3, (w * z).sum()], [(w * z).sum(), w.sum() + 1e-3]])
            da, db = np.linalg.solve(hessian, [(r * z).sum(), r.sum()])
            a, b = float(np.clip(a + da, 0.05, 20)), float(np.clip(b + db, -20, 20))
        self.scale = (a, b)
        self.threshold = self.lowest(z, y, n, precision)

    def lowest(self, z: np.ndarray, y: np.ndarray, n: np.ndarray, precision: float) -> float:
        p = self._scaled(z)
        order = np.argsort(-p, kind="stable")
        right = np.cumsum((y * n)[order]) / np.cumsum(n[order])
        last = np.append(p[order][1:] != p[order][:-1], True)
        fine = np.flatnonzero((right >= precision) & last)
        if not len(fine):
            return 1.1
        below = p[order][fine[-1] + 1] if fine[-1] + 1 < len(p) else 0.0  # in the middle of the gap under the last row taken
        return float(max((p[order][fine[-1]] + below) / 2, 0.5))


def candidates(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Labelled rows of each text, its own and planted ones; a third of them, by a hash of the span, is kept from the fit."""
    for batch in batches:
        rows = [([float(v) for v in features(t, k, a, b)], y, int(hashlib.md5(t[a:b].encode()).hexdigest()[:8], 16) % 3 == 0, own and i < len(spans_of[0]))
                for text in batch["text"] for spans_of in [spans(text)]
                for own, several in ((True, [(text, *c) for c in spans_of[1]]), (False, planted(text, spans_of[0])))
                for i, (t, k, a, b, y) in enumerate(several) if y >= 0]
        yield pd.DataFrame(rows, columns=["x", "y", "kept", "base"])


def gathered(batches: Iterator[pd.DataFrame], rows: int = 65_536) -> Iterator[pd.DataFrame]:
    """Batches of about ``rows`` rows, for work whose calls cost more than their rows."""
    held, n = [], 0
    for batch in batches:
        held, n = [*held, batch], n + len(batch)
        if n >= rows:
            yield pd.concat(held)
            held, n = [], 0
    if n:
        yield pd.concat(held)


def fit(docs: DataFrame, bound: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> Boosted | None:
    """Trees fitted on the candidates of all documents, or of the ``bound`` lowest draws; None where they have no candidates of both labels."""
    texts = ready(docs).where(F.col(text_col).isNotNull()).select(F.col(text_col).alias("text"), F.xxhash64(F.col(id_col), F.lit("pii")).alias("drawn"))
    if bound is not None:
        texts = texts.orderBy("drawn", F.xxhash64("text")).limit(bound).repartition(partitions(docs))
    found = texts.select("text").mapInPandas(candidates, "x array<double>, y int, kept boolean, base boolean")
    found = stage(found.groupBy("x", "y", "kept", "base").agg(F.count(F.lit(1)).alias("n")), "personal_candidates")
    labels = {bool(r.kept): r.labels for r in found.groupBy("kept").agg(F.countDistinct("y").alias("labels")).collect()}
    if len(labels) == 1:
        found = found.withColumn("kept", F.pmod(F.xxhash64("x"), F.lit(3)) == 0)
        labels = {bool(r.kept): r.labels for r in found.groupBy("kept").agg(F.countDistinct("y").alias("labels")).collect()}
    if labels.get(True) != 2 or labels.get(False) != 2:
        return None
    return _fitted(found)


def _fitted(found: DataFrame) -> Boosted:
    """Trees of the rows ``(x, y, kept, base, n)`` that are not kept, thresholds of those that are."""
    learnt = found.where("not kept")
    at = learnt.select("n", F.posexplode("x").alias("j", "v")).groupBy("j").agg(F.percentile("v", quantiles(), F.col("n")).alias("cuts"))
    cuts = [np.unique(r.cuts) for r in sorted(at.collect(), key=lambda r: r.j)]

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                yield pd.DataFrame({"bins": [r.tobytes() for r in binned(np.stack(batch["x"]), cuts)], "y": batch["y"], "n": batch["n"]})

    rows = learnt.select("x", "y", "n").mapInPandas(cut, "bins binary, y int, n bigint").groupBy("bins", "y").agg(F.sum("n").alias("n"))
    rows = stage(rows, "personal_rows")
    different, right, whole = rows.agg(F.count(F.lit(1)), F.sum(F.col("y") * F.col("n")), F.sum("n")).first()
    model = Boosted()

    def arrays(batch: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        bins = np.frombuffer(b"".join(batch["bins"]), np.uint8).reshape(len(batch), -1)
        return np.asfortranarray(bins), batch["y"].to_numpy(float), batch["n"].to_numpy(float)

    if different <= LOCAL_ROWS:
        here = arrays(rows.toPandas())

        def sums(start: float, trees: list, nodes: list) -> np.ndarray:
            return level_sums(*here, start, trees, nodes)
    else:
        def sums(start: float, trees: list, nodes: list) -> np.ndarray:
            shape = (3, len(nodes), len(cuts), BINS)

            def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
                out = np.zeros(shape, np.int64)
                for batch in gathered(batches):
                    out += level_sums(*arrays(batch), start, trees, nodes)
                slots = np.flatnonzero(out)
                yield pd.DataFrame({"slot": slots, "value": out.ravel()[slots]})

            added = rows.mapInPandas(part, "slot bigint, value bigint").groupBy("slot").agg(F.sum("value").alias("value")).toPandas()
            out = np.zeros(int(np.prod(shape)), np.int64)
            out[added["slot"].to_numpy(int)] = added["value"].to_numpy(np.int64)
            return out.reshape(shape)

    model.grow(cuts, right / whole, sums)

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                x = np.stack(batch["x"])
                yield batch.drop(columns="x").assign(z=np.rint(model.raw(x) * 10 ** DIGITS).astype(np.int64), kind=x[:, 0].astype(np.int32))

    scored = found.where("kept").select("x", "y", "base", "n").mapInPandas(score, "y int, base boolean, n bigint, z bigint, kind int")
    kept = scored.groupBy("z", "kind", "base", "y").agg(F.sum("n").alias("n")).orderBy("z", "kind", "base", "y").toPandas()
    z, y, n, kind = (kept["z"].to_numpy(float) / 10 ** DIGITS, *(kept[c].to_numpy(float) for c in ("y", "n", "kind")))
    model.calibrate_scores(z, y, n, PRECISION)
    # base spans are right by their rules and say nothing about the precision of added ones
    loose = ~kept["base"].to_numpy(bool)
    model.kinds = {k: model.lowest(z[own], y[own], n[own], PRECISION) for k in range(len(KINDS)) if (own := loose & (kind == k)).any()}
    return model


def chosen(text: str | None, model: Boosted | None) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """(base spans, all spans) of a text, each as (kind, start, end) in order; added spans do not repeat a base span."""
    base, candidates = spans(text or "")
    extra = candidates[len(base):]
    if model is None or not extra:
        return base, base
    p = model.probability(np.array([features(text, k, a, b) for k, a, b, _ in extra], float))
    return base, sorted({*base, *[(k, a, b) for (k, a, b, _), v in zip(extra, p) if v >= model.kinds.get(k, 1.1)]})


def listed(found: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in found)


def find_personal_data(docs: DataFrame, model: Boosted | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans.

    Counts and digest are of the base kinds; ``spans`` holds base and added ones as kind:start:end in code points, end
    exclusive. Null and empty texts have none.
    """
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for text in batch["text"]:
                base, everything = chosen(text, model)
                counts = [sum(k == i for k, _, _ in base) for i in range(4)]
                rows.append((*counts, hashlib.sha256(listed(base).encode()).hexdigest(), listed(everything)))
            out = pd.DataFrame(rows, columns=["n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"])
            yield out.assign(doc_id=batch["doc_id"])[["doc_id", *out.columns]]

    kind = dict(ready(docs).dtypes)[id_col]
    return docs.selectExpr(f"`{id_col}` as doc_id", f"`{text_col}` as text").mapInPandas(
        run, f"doc_id {kind}, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string")


def redact(docs: DataFrame, model: Boosted | None, text_col: str = "text") -> DataFrame:
    """``docs`` with every chosen span of the text replaced by its kind in angle brackets; overlapping spans become one."""
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([cleaned(t, chosen(t, model)[1]) for t in batch], dtype=object)

    return ready(docs).withColumn(text_col, F.pandas_udf(run, "string")(F.col(text_col)))


def cleaned(text: str | None, found: list[tuple[int, int, int]]) -> str | None:
    if not found:
        return text
    out, free = [], 0
    for kind, a, b in sorted(found, key=lambda s: (s[1], -s[2])):
        if a >= free:
            out += [text[free:a], f"<{KINDS[kind]}>"]
        free = max(free, b)
    return "".join(out) + text[free:]
