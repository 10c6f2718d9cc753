"""Table structure metrics. Tree and grid alignments have no relational form;
they run in Arrow batches, a row being one pair of tables. Pairs of one shape
take the same steps, so these are made for all such pairs of a batch at once."""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Callable
from html.parser import HTMLParser

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

# ------------------------------------------------------------------ trees


def _span(stated: str | None) -> int:
    """A stated span; one that is no number counts as 1."""
    return int(stated) if stated and stated.strip().isdecimal() else 1


class _Reader(HTMLParser):
    """(tag, colspan, rowspan, text, children) of the first table."""

    KEEP = ("table", "thead", "tbody", "tr", "td")

    def __init__(self):
        super().__init__()
        self.root, self.open = None, []

    def handle_starttag(self, tag, attrs):
        tag = "td" if tag == "th" else tag
        if tag in self.KEEP and (self.open or (tag == "table" and self.root is None)):
            a = dict(attrs)
            node = [tag, _span(a.get("colspan")), _span(a.get("rowspan")), "", []]
            if self.open:
                self.open[-1][4].append(node)
            else:
                self.root = node
            self.open.append(node)

    def handle_endtag(self, tag):
        tag = "td" if tag == "th" else tag
        if any(n[0] == tag for n in self.open):
            while self.open.pop()[0] != tag:
                pass

    def handle_data(self, data):
        if self.open and self.open[-1][0] == "td":
            self.open[-1][3] = " ".join((self.open[-1][3] + " " + data).split())


def tree(html: str) -> list | None:
    """The first table, or none."""
    reader = _Reader()
    reader.feed(html)
    return reader.root


#: Tags as most tables have them; texts with anything else are left to the parser.
PLAIN = re.compile(r"<(/?(?:table|thead|tbody|tr|td|th))>")


def read_nodes(html: str) -> tuple[list, list[int]] | None:
    """Nodes of the first table in postorder and each one's leftmost leaf, or none."""
    parts = PLAIN.split(html)
    if "&" in html or html.count("<") != len(parts) // 2:
        root = tree(html)
        return None if root is None else _postorder(root)
    nodes: list = []
    leftmost: list[int] = []
    opened: list[list] = []  # node, leftmost leaf below
    begun = False

    def close() -> str:
        node, first = opened.pop()
        nodes.append(node)
        leftmost.append(len(nodes) - 1 if first is None else first)
        if opened and opened[-1][1] is None:
            opened[-1][1] = leftmost[-1]
        return node[0]

    for tag, data in zip(parts[1::2], parts[2::2], strict=True):
        ends, tag = tag[0] == "/", tag.lstrip("/").replace("th", "td") if tag.endswith("th") else tag.lstrip("/")
        if not ends and (opened or (tag == "table" and not begun)):
            begun = True
            opened.append([[tag, 1, 1, ""], None])
        elif ends and any(n[0] == tag for n, _ in opened):
            while close() != tag:
                pass
        if data and opened and opened[-1][0][0] == "td":
            node = opened[-1][0]
            node[3] = " ".join((node[3] + " " + data).split())
    while opened:
        close()
    return (nodes, leftmost) if begun else None


def edit_distance(a, b) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        left, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            left, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, left + (x != y))
    return row[-1]


def _postorder(root: list) -> tuple[list, list[int]]:
    """Nodes in postorder and each one's leftmost leaf."""
    nodes: list = []
    leftmost: list[int] = []

    # a stack of its own, as tables may nest deeper than calls can
    stack: list[list] = [[root, 0, None]]  # node, children dealt with, leftmost leaf below
    while stack:
        top = stack[-1]
        node, done, _ = top
        if done < len(node[4]):
            top[1] += 1
            stack.append([node[4][done], 0, None])
            continue
        stack.pop()
        nodes.append(node)
        leftmost.append(len(nodes) - 1 if top[2] is None else top[2])
        if stack and stack[-1][2] is None:
            stack[-1][2] = leftmost[-1]
    return nodes, leftmost


def _keys(left: list[int]) -> list[int]:
    return sorted({x: i for i, x in enumerate(left)}.values())


def _distance(al: list[int], bl: list[int], cost: Callable, least: Callable, zero) -> float | np.ndarray:
    """Ordered tree edit distance by forests of key roots: of one pair, or of
    all pairs with these leftmost leaves, ``cost`` and ``zero`` being arrays."""
    done = [[zero] * len(bl) for _ in al]
    for i in _keys(al):
        for j in _keys(bl):
            io, jo = al[i], bl[j]
            f = [[zero] * (j - jo + 2) for _ in range(i - io + 2)]
            for x in range(1, i - io + 2):
                f[x][0] = zero + x
            for y in range(1, j - jo + 2):
                f[0][y] = zero + y
            for x in range(1, i - io + 2):
                for y in range(1, j - jo + 2):
                    n, m = io + x - 1, jo + y - 1
                    drop = least(f[x - 1][y], f[x][y - 1]) + 1
                    if al[n] == io and bl[m] == jo:
                        f[x][y] = done[n][m] = least(drop, f[x - 1][y - 1] + cost(n, m))
                    else:
                        f[x][y] = least(drop, f[al[n] - io][bl[m] - jo] + done[n][m])
    return done[-1][-1]


def tree_distance(a: list, b: list, cost: Callable) -> float:
    (an, al), (bn, bl) = _postorder(a), _postorder(b)
    return _distance(al, bl, lambda n, m: cost(an[n], bn[m]), min, 0.0)


def _change(x: str, y: str) -> float:
    return edit_distance(x, y) / max(len(x), len(y))


def _cost(structure_only: bool) -> Callable:
    def cost(x, y) -> float:
        if x[:3] != y[:3]:
            return 1.0
        if structure_only or x[0] != "td" or x[3] == y[3]:
            return 0.0
        return _change(x[3], y[3])

    return cost


def _similarity(a: tuple, b: tuple, structure_only: bool) -> float:
    """1 - tree edit distance / size of the larger tree."""
    (an, al), (bn, bl) = a, b
    if al == bl and all(x[:4] == y[:4] for x, y in zip(an, bn, strict=True)):
        return 1.0
    cost = _cost(structure_only)
    return 1.0 - _distance(al, bl, lambda n, m: cost(an[n], bn[m]), min, 0.0) / max(len(an), len(bn))


#: Pairs of one shape from which their steps are made at once, numbers that
#: these steps hold, and remembered comparisons of two texts.
TOGETHER, HELD, REMEMBERED = 8, 1 << 21, 1 << 20


class _Pairs:
    """A function of two texts, given by their numbers in ``texts``, once for
    each pair of numbers."""

    def __init__(self, f: Callable, texts: list[str]):
        self.f, self.texts, self.known = f, texts, {}

    def __call__(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        each, at = np.unique(a.astype(np.int64) * len(self.texts) + b, return_inverse=True)
        out = np.empty(len(each))
        for i, key in enumerate(each.tolist()):
            if (v := self.known.get(key)) is None:
                if len(self.known) >= REMEMBERED:
                    self.known.clear()
                v = self.known[key] = self.f(self.texts[key // len(self.texts)], self.texts[key % len(self.texts)])
            out[i] = v
        return out[at]


def _similarities(pairs: list[tuple | None], modes: list[bool]) -> np.ndarray:
    """A column for each of ``modes`` (structure only or not), NaN without a pair."""
    out = np.full((len(pairs), len(modes)), np.nan)
    shapes: dict = defaultdict(list)
    for at, pair in enumerate(pairs):
        if pair:
            shapes[tuple(pair[0][1]), tuple(pair[1][1])].append(at)
    for (al, bl), members in shapes.items():
        chunk = HELD // (len(al) * len(bl))
        if min(chunk, len(members)) < TOGETHER:
            for at in members:
                out[at] = [_similarity(*pairs[at], m) for m in modes]
            continue
        for start in range(0, len(members), chunk):
            part = members[start : start + chunk]
            kinds: dict = {}
            texts: dict = {}
            number = lambda side, cut, known, part=part: np.array([[known.setdefault(cut(x), len(known)) for x in pairs[at][side][0]] for at in part])
            (ka, kb), (ta, tb) = ([number(side, cut, known) for side in (0, 1)] for cut, known in ((lambda x: tuple(x[:3]), kinds), (lambda x: x[3], texts)))
            change, zero = _Pairs(_change, list(texts)), np.zeros(len(part))
            for k, structure_only in enumerate(modes):

                def cost(n, m, ka=ka, kb=kb, ta=ta, tb=tb, change=change, structure_only=structure_only):
                    c = (ka[:, n] != kb[:, m]).astype(float)
                    # nodes that hold no text have equal ones
                    if not structure_only and (other := (c == 0) & (ta[:, n] != tb[:, m])).any():
                        c[other] = change(ta[other, n], tb[other, m])
                    return c

                out[part, k] = 1.0 - _distance(al, bl, cost, np.minimum, zero) / max(len(al), len(bl))
    return out


def teds_of(pred: str, gold: str, structure_only: bool = False) -> float:
    """Similarity of the first tables of two texts, an error without one."""
    a, b = read_nodes(pred), read_nodes(gold)
    if a is None or b is None:
        raise ValueError("no table")
    return _similarity(a, b, structure_only)


def _read_pairs(p: pd.Series, g: pd.Series) -> list[tuple | None]:
    nodes = ((x and read_nodes(x), y and read_nodes(y)) for x, y in zip(p, g, strict=True))
    return [(a, b) if a and b else None for a, b in nodes]


def teds(pred: Column, gold: Column, structure_only: bool = False) -> Column:
    """The same for columns; null where a text is null or has no table."""

    @F.pandas_udf("double")
    def run(p: pd.Series, g: pd.Series) -> pd.Series:
        return pd.Series(_similarities(_read_pairs(p, g), [structure_only])[:, 0])

    return run(pred, gold)


def teds_both(pred: Column, gold: Column) -> Column:
    """struct<teds, teds_struct>: both similarities from one reading of the texts."""

    @F.pandas_udf("teds double, teds_struct double")
    def run(p: pd.Series, g: pd.Series) -> pd.DataFrame:
        return pd.DataFrame(_similarities(_read_pairs(p, g), [False, True]), columns=["teds", "teds_struct"])

    return run(pred, gold)


# ------------------------------------------------------------------ grids


def common(a: str, b: str) -> int:
    """Length of the longest common subsequence; the bits of one whole number
    are the places of ``a``."""
    places: dict[str, int] = {}
    for i, x in enumerate(a):
        places[x] = places.get(x, 0) | 1 << i
    every = rest = (1 << len(a)) - 1
    for y in b:
        if hit := rest & places.get(y, 0):
            rest = (rest + hit | rest - hit) & every
    return len(a) - rest.bit_count()


def _cell(kind: str) -> Callable:
    def text(x, y) -> float:
        n = len(x["text"]) + len(y["text"])
        return 2.0 * common(x["text"], y["text"]) / n if n else 1.0

    def span(x, y) -> float:
        a, b = (x.get("rowspan", 1), x.get("colspan", 1)), (y.get("rowspan", 1), y.get("colspan", 1))
        both = min(a[0], b[0]) * min(a[1], b[1])
        return both / (a[0] * a[1] + b[0] * b[1] - both)

    def place(x, y) -> float:
        a, b = x.get("bbox"), y.get("bbox")
        if a is None or b is None:
            return 0.0
        both = max(0.0, min(a[2], b[2]) - max(a[0], b[0])) * max(0.0, min(a[3], b[3]) - max(a[1], b[1]))
        union = (a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - both
        return both / union if union > 0 else 0.0

    return {"con": text, "top": span, "loc": place}[kind]


def _best(a: list, b: list, gain: Callable) -> float:
    """Largest total gain of an order-keeping alignment."""
    row = [0.0] * (len(b) + 1)
    for x in a:
        left = 0.0
        for j, y in enumerate(b, 1):
            left, row[j] = row[j], max(row[j], row[j - 1], left + gain(x, y))
    return row[-1]


def grits_of(pred: list, gold: list, kind: str = "con") -> tuple[float, float, float]:
    """(precision, recall, f) of two grids, rows of cells."""
    cell = _cell(kind)
    n, m = sum(map(len, pred)), sum(map(len, gold))
    if not n or not m:
        return 0.0, 0.0, 0.0
    total = _best(pred, gold, lambda r, s: _best(r, s, cell))
    return total / n, total / m, 2 * total / (n + m)


class _Grids:
    """A batch of grids, flattened: rows of each grid, cells of each row, and
    the cells' fields. Null grids, rows and cells are empty ones."""

    def __init__(self, grids: pa.Array):
        size = lambda a: pc.fill_null(pc.list_value_length(a), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        start = lambda n: np.cumsum(n) - n
        rows = grids.flatten()
        cells = rows.flatten()
        self.n_rows, self.width = size(grids), size(rows)
        self.first_row, self.first_cell = start(self.n_rows), start(self.width)
        self.fields = dict(zip([f.name for f in cells.type], cells.flatten(), strict=True))
        self.n = len(cells)
        at = np.repeat(np.arange(len(grids)), self.n_rows)
        self.n_cells = np.bincount(at, self.width, len(grids)).astype(np.int64)
        self.widest = np.zeros(len(grids), dtype=np.int64)
        np.maximum.at(self.widest, at, self.width)

    def numbers(self, name: str) -> np.ndarray:
        found = self.fields.get(name)
        return np.ones(self.n) if found is None else pc.fill_null(found.cast(pa.float64()), 1.0).to_numpy(zero_copy_only=False)

    def texts(self) -> pa.Array:
        found = self.fields.get("text")
        return pa.array([""] * self.n, pa.string()) if found is None else pc.fill_null(found.cast(pa.string()), "")

    def boxes(self) -> tuple[np.ndarray, np.ndarray]:
        """Four numbers a cell, and which cells have them."""
        out, found = np.zeros((self.n, 4)), self.fields.get("bbox")
        has = np.zeros(self.n, dtype=bool) if found is None else pc.is_valid(found).to_numpy(zero_copy_only=False)
        if has.any():
            n = pc.list_value_length(found.filter(pa.array(has))).to_numpy(zero_copy_only=False).astype(np.int64)
            flat = found.flatten()
            if n.min() < 4 or flat.null_count:
                raise ValueError("a bbox has four numbers")
            out[has] = flat.cast(pa.float64()).to_numpy(zero_copy_only=False)[(np.cumsum(n) - n)[:, None] + np.arange(4)]
        return out, has

    def cells_at(self, rows: np.ndarray, x: int) -> np.ndarray:
        """The x-th cell of each row, -1 where it has none."""
        return np.where(x < self.width[rows], self.first_cell[rows] + x, -1)


def _gains(kind: str, a: _Grids, b: _Grids) -> Callable:
    """``_cell`` for arrays of cells' numbers."""
    if kind == "con":
        codes = pa.concat_arrays([a.texts(), b.texts()]).dictionary_encode()
        texts, code = codes.dictionary.to_pylist(), codes.indices.to_numpy(zero_copy_only=False)
        ca, cb = code[: a.n], code[a.n :]
        alike = _Pairs(lambda x, y: 2.0 * common(x, y) / (len(x) + len(y)), texts)

        def text(x, y):
            out, u, v = np.ones(len(x)), ca[x], cb[y]
            if (other := u != v).any():
                out[other] = alike(u[other], v[other])
            return out

        return text
    if kind == "top":
        (ar, ac), (br, bc) = ([g.numbers(c) for c in ("rowspan", "colspan")] for g in (a, b))

        def span(x, y):
            both = np.minimum(ar[x], br[y]) * np.minimum(ac[x], bc[y])
            return both / (ar[x] * ac[x] + br[y] * bc[y] - both)

        return span
    (ab, ah), (bb, bh) = a.boxes(), b.boxes()

    def place(x, y):
        p, q = ab[x].T, bb[y].T
        both = np.maximum(0.0, np.minimum(p[2], q[2]) - np.maximum(p[0], q[0])) * np.maximum(0.0, np.minimum(p[3], q[3]) - np.maximum(p[1], q[1]))
        union = (p[2] - p[0]) * (p[3] - p[1]) + (q[2] - q[0]) * (q[3] - q[1]) - both
        return np.where(ah[x] & bh[y] & (union > 0), both / np.where(union > 0, union, 1.0), 0.0)

    return {"loc": place}[kind]


def _totals(a: _Grids, b: _Grids, kind: str) -> np.ndarray:
    """The largest total gain of each pair of grids: ``_best`` of ``_best``
    with the same steps for all pairs of one shape. Cells that a row of the
    shape lacks gain nothing, which leaves the largest total as it is."""
    out, gains = np.zeros(len(a.n_rows)), _gains(kind, a, b)
    some = np.flatnonzero((a.n_cells > 0) & (b.n_cells > 0))
    if not len(some):
        return out
    shapes, of = np.unique(np.stack([x[some] for x in (a.n_rows, b.n_rows, a.widest, b.widest)], axis=1), axis=0, return_inverse=True)
    order = np.argsort(of.ravel(), kind="stable")
    for shape, members in zip(shapes.tolist(), np.split(some[order], np.cumsum(np.bincount(of.ravel(), minlength=len(shapes)))[:-1]), strict=True):
        n, m, p, q = shape
        chunk = max(1, HELD // (m * (q + 1)))
        for start in range(0, len(members), chunk):
            at = members[start : start + chunk]
            theirs = b.first_row[at][:, None] + np.arange(m)
            other = [b.cells_at(theirs, y) for y in range(q)]
            total = [np.zeros(len(at)) for _ in range(m + 1)]
            for i in range(n):
                row = [np.zeros((len(at), m)) for _ in range(q + 1)]
                for x in range(p):
                    mine, left = np.broadcast_to(a.cells_at(a.first_row[at] + i, x)[:, None], theirs.shape), row[0]
                    for y in range(q):
                        both = (mine >= 0) & (other[y] >= 0)
                        gain = np.zeros(theirs.shape)
                        gain[both] = gains(mine[both], other[y][both])
                        left, row[y + 1] = row[y + 1], np.maximum(np.maximum(row[y + 1], row[y]), left + gain)
                left = total[0]
                for j in range(m):
                    left, total[j + 1] = total[j + 1], np.maximum(np.maximum(total[j + 1], total[j]), left + row[q][:, j])
            out[at] = total[m]
    return out


CELLS = "array<array<struct<text: string, rowspan: int, colspan: int>>>"


def grits(pred: Column, gold: Column, kind: str = "con") -> Column:
    """struct<p, r, f> of two grids of type CELLS; nulls where a grid is null.
    Null rows are empty, null texts too; cells may have a bbox, an array of four
    numbers, for kind ``loc``."""
    _cell(kind)

    @F.arrow_udf("p double, r double, f double")
    def run(p: pa.Array, g: pa.Array) -> pa.Array:
        a, b = _Grids(p), _Grids(g)
        total, n, m = _totals(a, b, kind), a.n_cells, b.n_cells
        empty, none = (n == 0) | (m == 0), ~pc.and_(pc.is_valid(p), pc.is_valid(g)).to_numpy(zero_copy_only=False)
        rate = lambda x, of: pa.array(np.where(empty, 0.0, x / np.where(empty, 1, of)), mask=none)
        return pa.StructArray.from_arrays([rate(total, n), rate(total, m), rate(2 * total, n + m)], ["p", "r", "f"])

    return run(pred, gold)
