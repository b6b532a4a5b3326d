"""URL filter: rules first, then gradient-boosted trees on lexical features."""

from __future__ import annotations

import math
import random
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FEATURES = (
    "url_length", "host_length", "path_length", "query_length", "depth", "labels", "digit_ratio", "host_digit_ratio", "hyphens",
    "host_entropy", "path_entropy", "params", "longest_label", "vowel_ratio", "suffix1", "suffix2", "part",
)


def lowered(s: str) -> str:
    """A-Z lower-cased, nothing else."""
    return s.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")


def split_url(url: str | None) -> tuple[str, str]:
    """(host, path): what follows the first ``://`` up to /, ?, # or the end, A-Z lower-cased; then up to ?, # or the end."""
    if url is None or "://" not in url:
        return "", ""
    host, path = re.match(r"([^/?#]*)([^?#]*)", url.split("://", 1)[1]).groups()
    return lowered(host), path


@dataclass(frozen=True)
class Rules:
    """``(verdict, host + path)`` rules. A rule fits its host and all subdomains where the url's path starts with its own; the longest wins."""

    rules: tuple[tuple[str, str], ...]
    by_host: dict = field(default_factory=dict, compare=False)

    def __post_init__(self):
        for verdict, rule in self.rules:
            host, slash, path = rule.partition("/")
            self.by_host.setdefault(lowered(host), []).append((slash + path, rule, verdict))

    def find(self, host: str, path: str) -> tuple[str, str] | None:
        """(rule, verdict), or None."""
        best, labels = None, host.split(".")
        for i in range(len(labels)):
            for start, rule, verdict in self.by_host.get(".".join(labels[i:]), ()):
                if path.startswith(start) and (best is None or len(rule) > len(best[0])):
                    best = rule, verdict
        return best


def _entropy(s: str) -> float:
    n = len(s)
    return -sum(c / n * math.log2(c / n) for c in Counter(s).values()) if n else 0.0


def _suffixes(host: str) -> tuple[str, str]:
    labels = host.split(".")
    return labels[-1], ".".join(labels[-2:])


def _parts(host: str) -> set[str]:
    """Runs of letters in a host's labels but the last, marked so that they are no suffixes."""
    return {"~" + x for x in re.findall(r"[a-z]{3,}", host.rpartition(".")[0])}


def lexical(url: str | None, suffixes: dict[str, float]) -> list[float]:
    """FEATURES of one url; a null url has those of the empty one."""
    url = url or ""
    host, path = split_url(url)
    query = url.partition("?")[2].partition("#")[0]
    rest, digits = len(url) or 1, sum(map(str.isdigit, url))
    s1, s2 = _suffixes(host)
    letters = [c for c in host if c.isalpha()]
    return [
        len(url), len(host), len(path), len(query), sum(1 for x in path.split("/") if x), host.count(".") + bool(host), digits / rest,
        sum(map(str.isdigit, host)) / (len(host) or 1), host.count("-"), _entropy(host), _entropy(path),
        sum(1 for x in query.split("&") if x), max(map(len, host.split("."))), sum(c in "aeiou" for c in letters) / (len(letters) or 1),
        suffixes.get(s1, 0.0), suffixes.get(s2, 0.0), max((suffixes.get(x, 0.0) for x in _parts(host)), default=0.0),
    ]


def suffix_statistics(urls: list[str], block: np.ndarray, weight: float = 10.0) -> dict[str, float]:
    """Shrunk log-odds of a block for each host suffix of one and two labels and each part of a name, against all urls'."""
    base = (block.sum() + 1) / (len(block) + 2)
    n, bad = Counter(), Counter()
    for u, y in zip(urls, block, strict=True):
        host = split_url(u)[0]
        for s in {*_suffixes(host), *_parts(host)}:
            n[s] += 1
            bad[s] += int(y)
    odds = lambda p: math.log(p / (1 - p))
    return {s: odds((bad[s] + weight * base) / (n[s] + weight)) - odds(base) for s in n}


@dataclass
class Trees:
    """Boosted trees for a yes/no answer. Each tree: feature and threshold of each inner node of a full tree, values of its leaves."""

    start: float
    feature: np.ndarray
    threshold: np.ndarray
    leaf: np.ndarray

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, rounds: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 32, penalty: float = 1.0) -> Trees:
        """Second-order boosting of the logistic loss over quantile bins."""
        n, m = x.shape
        cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(m)]
        place = np.stack([np.searchsorted(cuts[j], x[:, j], side="left") for j in range(m)], 1)
        p = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        start = math.log(p / (1 - p))
        score, inner = np.full(n, start), 2**depth - 1
        feature, threshold, leaf = np.zeros((rounds, inner), int), np.full((rounds, inner), np.inf), np.zeros((rounds, inner + 1))
        for r in range(rounds):
            q = 1 / (1 + np.exp(-score))
            g, h, node = q - y, q * (1 - q), np.zeros(n, int)
            for at in range(inner):
                rows = np.flatnonzero(node == at)
                go = np.zeros(len(rows), bool)
                best = 1e-6
                for j in range(m):
                    k = len(cuts[j]) + 1
                    gs, hs = (np.cumsum(np.bincount(place[rows, j], w[rows], k)) for w in (g, h))
                    left = gs[:-1] ** 2 / (hs[:-1] + penalty) + (gs[-1] - gs[:-1]) ** 2 / (hs[-1] - hs[:-1] + penalty) - gs[-1] ** 2 / (hs[-1] + penalty)
                    if len(left) and left.max() > best:
                        c = int(left.argmax())
                        best, feature[r, at], threshold[r, at] = left[c], j, cuts[j][c]
                        go = place[rows, j] > c
                node[rows] = 2 * at + 1 + go
            for at in range(inner + 1):
                rows = node == inner + at
                leaf[r, at] = -rate * g[rows].sum() / (h[rows].sum() + penalty)
            score += leaf[r][node - inner]
        return cls(start, feature, threshold, leaf)

    def predict(self, x: np.ndarray) -> np.ndarray:
        """Probability of yes for each row."""
        score, inner = np.full(len(x), self.start), self.feature.shape[1]
        for f, t, leaf in zip(self.feature, self.threshold, self.leaf, strict=True):
            node = np.zeros(len(x), int)
            while inner and node[0] < inner if len(x) else False:
                node = 2 * node + 1 + (x[np.arange(len(x)), f[node]] > t[node])
            score += leaf[node - inner]
        return 1 / (1 + np.exp(-score))


@dataclass
class UrlModel:
    trees: Trees
    suffixes: dict[str, float]

    @classmethod
    def fit(cls, urls: list[str], block: np.ndarray) -> UrlModel:
        """Each url is learned twice, once as if nothing were known of its name, so that the trees can judge names that they have not met."""
        suffixes = suffix_statistics(urls, block)
        known, unknown = (np.array([lexical(u, s) for u in urls], float) for s in (suffixes, {}))
        return cls(Trees.fit(np.concatenate([known, unknown]), np.concatenate([block, block])), suffixes)

    def blocked(self, urls: list[str | None]) -> np.ndarray:
        """Probability that each url is one to block."""
        return self.trees.predict(np.array([lexical(u, self.suffixes) for u in urls], float).reshape(len(urls), len(FEATURES)))


def train(labelled: DataFrame, max_rows: int = 20_000, url_col: str = "url", label_col: str = "block") -> UrlModel:
    """Fit to a bounded sample of labelled urls: the ``max_rows`` with the smallest hashes. Rows with a null stay out."""
    rows = (
        labelled.select(F.col(url_col).cast("string").alias("u"), F.col(label_col).cast("int").alias("y")).dropna()
        .orderBy(F.xxhash64("u"), "u", "y").limit(max_rows).collect()
    )
    if not rows:
        raise ValueError("no labelled urls")
    urls, y = [r["u"] for r in rows], np.array([r["y"] for r in rows], float)
    return UrlModel.fit(urls, y)


#: Words for example urls: of ordinary sites, and of sites that advertise themselves.
ORDINARY = (
    "academy anchor archive atlas autumn bakery bicycle botany bridge cabinet camera canyon castle cedar chapel chess clinic coast college comet copper "
    "council cousin dairy delta dental diary dolphin eagle engine estate falcon family farmers ferry fiddle forest fossil galaxy garden geology gospel granite "
    "guitar gymnasium harbor harvest heritage history hotel insect island journal kayak kitchen lantern library lumber maple market meadow mirror museum "
    "nature observer orchard oxford parish pencil physics pilot planet pottery quarry rabbit railway recipe review river saddle school science sculpture "
    "season shelter sailing silver society station studio teacher temple theater timber tourism travel union valley village violin weather willow window"
).split()
LURES = (
    "adult ads affiliate backlinks bargain bet bets betting bitcoin bonus boost buy cams cash casino cheap clicks credit crypto dating deals detox diet "
    "discount dollars download earn escort farm fast forex free fun games gambling gifts girls hookup hot instant investment jackpot keno keto lend loan "
    "loans lottery luck lucky meds millionaire miracle money nude offers payday pharmacy pills poker popup porn prize profit promo quick ranker replica "
    "rewards rich roulette rx sale seo sexy singles slots spam spins steroids streams sweepstakes torrent track tracker traffic trial viagra vip wager "
    "warez wealth weightloss win winner xxx"
).split()


def example_urls(n: int = 6000, seed: int = 7, words: list[str] = ORDINARY, lures: list[str] = LURES) -> list[tuple[str, int]]:
    """(url, block): made-up labelled urls, half of each kind, where no labelled table is at hand.

    Ordinary sites are named by words, invented names or abbreviations, and have pages by date, title,
    number or query; others by lures, often in a row, with numbers or at random, and have such pages or
    tokens and long queries. Each kind has some of the other's habits.
    """
    r = random.Random(seed)
    pick, token = r.choice, lambda k: "".join(r.choices("abcdefghijklmnopqrstuvwxyz0123456789", k=k))
    some = lambda xs, low, high: [pick(xs) for _ in range(r.randint(low, high))]

    def ordinary_name() -> str:
        kind = r.random()
        if kind < 0.4:
            return "".join(some(words, 1, 2))
        if kind < 0.55:
            return "-".join(some(words, 2, 2))
        if kind < 0.8:
            return "".join(pick("bcdfghjklmnprstvwz") + pick("aeiou") for _ in range(r.randint(2, 5)))
        if kind < 0.93:
            return "".join(r.choices("abcdefghijklmnopqrstuvwxyz", k=r.randint(2, 9)))
        return pick(words) + str(r.randint(1, 2024))

    def lure_name() -> str:
        kind = r.random()
        if kind < 0.55:
            return "-".join(some(lures, 2, 3))
        if kind < 0.7:
            return "".join(some(lures, 1, 2)) + str(r.randint(1, 9999))
        if kind < 0.8:
            return f"{pick(lures)}-{pick(words)}"
        if kind < 0.9:
            return f"{pick(lures)}-{token(r.randint(1, 4))}"
        return token(r.randint(14, 30))

    def page() -> str:
        title = "-".join(some(words, 2, 6))
        return pick([
            "", "/", f"/{pick(words)}", f"/{r.randint(1995, 2025)}/{r.randint(1, 12):02}/{title}", f"/articles/{title}.htm", f"/{pick(words)}/{r.randint(1, 99999)}", f"/wiki/{pick(words).title()}",
            f"/index.php?id={r.randint(1, 5000)}", f"/search?q={pick(words)}&lang=it", f"/{title}/", f"/{r.randint(1, 99999)}", f"/{pick(words)}/{title}?print=1",
        ])

    def lure_page() -> str:
        query = "&".join(f"{token(r.randint(1, 4))}={token(r.randint(6, 24))}" for _ in range(r.randint(2, 8)))
        return pick([page(), page(), f"/go/{token(12)}", f"/?{query}", f"/{pick(lures)}/{token(8)}?{query}", f"/{'/'.join(token(5) for _ in range(r.randint(3, 7)))}"])

    out = []
    for i in range(n):
        block = i % 2
        name, path = (lure_name(), lure_page()) if block else (ordinary_name(), page())
        ends = ["com", "com", "org", "net", "info", "co.uk", "de", "eu"]
        end = pick(["top", "xyz", "click", "icu"]) if block and r.random() < 0.3 else pick(ends)
        before = pick(["", "", "www.", "www.", "mobile.", "news.", f"{pick(words)}.", f"{ordinary_name()}."])
        under = f".{pick(words)}" if r.random() < 0.25 else ""
        out.append((f"{pick(['http', 'https'])}://{before}{name}{under}.{end}{path}", block))
    return out


def example_table(spark: SparkSession, n: int = 6000, seed: int = 7) -> DataFrame:
    return spark.createDataFrame(example_urls(n, seed), "url string, block int")


def judge(pages: DataFrame, rules: Rules, model: UrlModel, threshold: float = 0.5, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(page_id, host, path, rule, verdict, blocked) for each row; blocked is the model's probability, null where a rule decides.

    A null url or one without ``://`` has an empty host and path, which no rule fits. Rules and
    model go with the code: both are bounded by what the caller lists and fits.
    """
    schema = "page_id long, host string, path string, rule string, verdict string, blocked double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            urls = b.column(1).to_pylist()
            parts = [split_url(u) for u in urls]
            found = [rules.find(*p) if p[0] else None for p in parts]
            ask = [i for i, f in enumerate(found) if f is None]
            p: list[float | None] = [None] * len(urls)
            for i, x in zip(ask, model.blocked([urls[i] for i in ask]) if ask else (), strict=True):
                p[i] = float(x)
            verdict = [f[1] if f else "block" if x >= threshold else "allow" for f, x in zip(found, p, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), *(pa.array(c, pa.string()) for c in ([x[0] for x in parts], [x[1] for x in parts], [f and f[0] for f in found], verdict)), pa.array(p, pa.float64())],
                names=["page_id", "host", "path", "rule", "verdict", "blocked"],
            )

    return pages.select(F.col(id_col).cast("long"), F.col(url_col).cast("string")).mapInArrow(run, schema)
