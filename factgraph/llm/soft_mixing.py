"""Mixing to target weights by soft membership, with DataFrame functions only.

A classifier fitted on a bounded sample of labelled documents gives every document a
probability for each domain, from quantiles of a few numbers about the text and from
the words that tell domains apart best. Each half of the sample is scored by what the
other half says, and probabilities are calibrated on that: documents of the same likeliest
domain and about the same probability get the shares of tokens that such documents'
labels have. So totals that are expected are totals by label too, at any rates, since
rates follow from the probabilities. Document rates r >= 0 are then
fitted so that the expected tokens of each domain, sum(r * tokens * probability), meet
its share of the corpus: least squares over the domain totals, each relative to the root
of its target, plus a small pull of every rate towards 1 (weighted by tokens), solved by
accelerated projected gradient.

Rates are a function of the memberships alone. For the fit, documents are gathered in
cells of a grid over the memberships, each with the mean membership of its tokens; their
number is bounded by grid and domains, not by the corpus. An iteration is one
aggregation that returns a number for each domain. A document's rate comes from its own
memberships and the residuals of past iterations: it is never shuffled but replayed from
those few numbers, on any row, in one expression. Text is measured once, scored once
when the classifier is known, and never moved between executors.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factgraph.llm.common import discard, stored

PULL = 0.002
ROUNDS = 200
CALM = 3
GRID = 64
MAX_TRAIN = 20_000
BINS = 16
#: Calibration: quantiles of the probability for each likeliest domain, and how many documents the uncalibrated probabilities count.
STEPS, BELIEF = 12, 4.0
#: Rounds of the fit after which points are written.
SAVE = 16
WORDS, LEAST_DOCS, MOST_SHARE, LEAST_ODD = 64, 5, 0.05, 5.0
FEATURES = ("chars", "word", "bars", "shouts", "digits", "again", "lines", "upper")
_MARKS = ".,;:!?\"'()[]|*#$%&\n\t\r"


def words(text: Column) -> Column:
    """Lower-cased words, without the marks around them."""
    return F.split(F.translate(F.lower(text), _MARKS, " " * len(_MARKS)), " ")


def features(docs: DataFrame) -> DataFrame:
    """``docs`` with _n (tokens: runs of non-space) and the struct _x of numbers about the text."""
    t = F.coalesce(F.col("text"), F.lit(""))
    chars = F.length(t)
    rows = docs.withColumns({"_n": F.regexp_count(t, F.lit(r"\S+")).cast("double"), "_c": chars.cast("double")})
    each = F.greatest(F.col("_n"), F.lit(1.0))
    count = lambda s: (chars - F.length(F.replace(t, F.lit(s), F.lit("")))).cast("double")
    x = {
        "chars": F.log1p("_c"),
        "word": F.col("_c") / each,
        "bars": count("|") / each,
        "shouts": count("!") / each,
        "digits": F.regexp_count(t, F.lit("[0-9]")) / each,
        "again": F.regexp_count(t, F.lit(r"(?<!\S)(\S+) \1(?!\S)")) / each,
        "lines": count("\n") / each,
        "upper": F.regexp_count(t, F.lit("[A-Z]")) / each,
    }
    return rows.withColumn("_x", F.struct(*(x[k].cast("double").alias(k) for k in FEATURES))).drop("_c")


def bins(edges: dict[str, list[float]]) -> Column:
    """For each feature, how many of its edges _x lies above."""
    above = lambda k: sum(((F.col(f"_x.{k}") > e).cast("int") for e in edges[k]), F.lit(0))
    return F.array(*(above(k) for k in FEATURES))


class Classifier:
    """What a sample of labelled documents says about domains.

    ``edges`` cuts the features into bins, of which ``stats`` has the logarithms of each
    domain's shares, with the number of its documents and what the absence of all
    ``words`` counts. ``words`` has for each domain in order what a word's presence adds.
    ``calibration`` has, for each likeliest domain in order, edges of its probability and the
    shares of all domains between them; without it probabilities stay as they are.
    """

    calibration: list[tuple[list[float], list[list[float]]]] | None = None

    def __init__(self, domains: list[str], edges: dict[str, list[float]], stats: dict[str, dict], words: dict[str, list[float]]):
        self.domains, self.edges, self.stats, self.words = domains, edges, stats, words

    def scored(self, measured: DataFrame, text: Column) -> DataFrame:
        """``measured`` with _p, the probabilities of the domains in order, from _x and the text."""
        total = sum(s["n"] for s in self.stats.values())
        if not total:
            return measured.withColumn("_p", F.array(*(F.lit(1.0 / len(self.domains)) for _ in self.domains)))
        logs = []
        for d in self.domains:
            s = self.stats.get(d)
            if s is None:
                logs.append(F.lit(-1e9))
                continue
            own = F.lit(s["without"])
            for k, f in enumerate(FEATURES):
                own = own + F.element_at(F.array(*map(F.lit, s["bins"][f])), F.element_at("_b", k + 1) + 1)
            logs.append(own)
        logs = F.array(*logs)
        if self.words:
            table = F.from_json(F.lit(json.dumps(self.words)), "map<string,array<double>>")
            hits = F.array_intersect(words(text), F.array(*map(F.lit, self.words)))
            logs = F.aggregate(hits, logs, lambda a, w: F.zip_with(a, F.element_at(table, w), lambda x, y: x + y))
        # Tempered: features hang together, and a product of all of them is surer than it should be.
        prior = F.array(*(F.lit(math.log(self.stats[d]["n"] / total) if d in self.stats else 0.0) for d in self.domains))
        each = lambda c: F.array_repeat(c, len(self.domains))
        raw = F.transform(F.zip_with("_l", each(F.array_max("_l")), lambda x, top: x - top), F.exp)
        whole = F.zip_with("_e", each(F.aggregate("_e", F.lit(0.0), lambda a, x: a + x)), lambda x, sum_: x / sum_)
        rows = measured.withColumn("_b", bins(self.edges)).withColumn("_l", F.zip_with(logs, prior, lambda x, y: x / 2 + y))
        return self.calibrated(rows.withColumn("_e", raw).withColumn("_p", whole).drop("_b", "_l", "_e"))

    def calibrated(self, rows: DataFrame) -> DataFrame:
        """``rows`` with _p as the shares of the documents that look alike."""
        if self.calibration is None:
            return rows
        held = rows.withColumn("_t", F.array_position("_p", F.array_max("_p")).cast("int")).withColumn("_q", F.array_max("_p"))
        shares = F.lit(None).cast("array<double>")
        for k, (edges, parts) in enumerate(self.calibration):
            own = F.element_at(F.array(*(F.array(*map(F.lit, x)) for x in parts)), sum(((F.col("_q") > e).cast("int") for e in edges), F.lit(1)))
            shares = F.when(F.col("_t") == k + 1, own).otherwise(shares)
        return held.withColumn("_p", shares).drop("_t", "_q")


def fit_classifier(measured: DataFrame, labelled: DataFrame, domains: list[str], max_train: int = MAX_TRAIN) -> Classifier:
    """From at most ``max_train`` labelled documents (doc_id, domain), chosen by a hash of the id.

    Shares of ``BINS`` quantiles of each feature, and the ``WORDS`` words whose documents
    divide among the domains least as chance would have it: in ``LEAST_DOCS`` documents at
    least, in a share of ``MOST_SHARE`` at most (whether a text has a common word follows
    from its length, and many such words say one thing many times over), and off by
    ``LEAST_ODD`` standard deviations for some domain. Two more fits, each on half of the
    sample, score the other half for the calibration.
    """
    own = labelled.filter(F.col("doc_id").isNotNull() & F.col("domain").isin(*domains)).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("domain").alias("domain"))
    picked = own.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_train)  # at most max_train rows of two short columns
    train = measured.select("doc_id", "_n", "_x", "_text").join(F.broadcast(picked), "doc_id")
    train = stored(train.select("domain", "_n", "_x", "_text", F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(2)).alias("_half")), "mix-training")
    out = _fit(train, domains)
    halves = [_fit(train.filter(F.col("_half") != k), domains).scored(train.filter(F.col("_half") == k), F.col("_text")) for k in (0, 1)]
    out.calibration = _calibration(halves[0].unionByName(halves[1]), domains)
    discard(train)
    return out


def _calibration(scored: DataFrame, domains: list[str]) -> list[tuple[list[float], list[list[float]]]]:
    """Edges and shares for each likeliest domain, from labelled documents (domain, _n, _p) that were not fitted on.

    Documents count by their tokens, which are what is mixed; ``BELIEF`` documents of mean
    length stand for the probabilities themselves, so that few labels do not decide alone.
    """
    d = len(domains)
    rows = scored.select("domain", F.greatest("_n", F.lit(1.0)).alias("_w"), "_p", F.array_position("_p", F.array_max("_p")).cast("int").alias("_t"), F.array_max("_p").alias("_q"))
    rows = stored(rows, "mix-calibration")
    cuts = [(k + 1) / STEPS for k in range(STEPS - 1)]
    edges: list[list[float]] = [[] for _ in domains]
    for r in rows.groupBy("_t").agg(F.percentile_approx("_q", cuts).alias("e")).collect():  # a row for each domain
        edges[r["_t"] - 1] = sorted(set(r.e))
    part = F.lit(0)
    for k in range(d):
        part = F.when(F.col("_t") == k + 1, sum(((F.col("_q") > e).cast("int") for e in edges[k]), F.lit(0))).otherwise(part)
    sums = [F.sum(F.when(F.col("domain") == x, F.col("_w")).otherwise(0.0)).alias(f"l{k}") for k, x in enumerate(domains)]
    sums += [F.sum(F.col("_w") * F.element_at("_p", k + 1)).alias(f"p{k}") for k in range(d)]
    found = {(r["_t"] - 1, r.part): r for r in rows.groupBy("_t", part.alias("part")).agg(F.count("*").alias("n"), F.sum("_w").alias("w"), *sums).collect()}  # domains times steps
    out = []
    for t in range(d):
        parts = []
        for k in range(len(edges[t]) + 1):
            r = found.get((t, k))
            if r is None:  # no labelled document looks like this
                parts.append([1.0 if j == t else 0.0 for j in range(d)])
                continue
            belief = BELIEF * r.w / r.n
            parts.append([(r[f"l{j}"] + belief * r[f"p{j}"] / r.w) / (r.w + belief) for j in range(d)])
        out.append((edges[t], parts))
    discard(rows)
    return out


def _fit(train: DataFrame, domains: list[str]) -> Classifier:
    """The classifier of labelled documents (domain, _x, _text), not calibrated."""
    cuts = [(k + 1) / BINS for k in range(BINS - 1)]
    found = train.agg(*(F.percentile_approx(f"_x.{k}", cuts).alias(k) for k in FEATURES)).first()
    edges = {k: sorted(set(found[k] or [])) for k in FEATURES}
    binned = train.select("domain", F.posexplode(bins(edges)).alias("k", "bin")).groupBy("domain", "k", "bin").agg(F.count("*").alias("n"))
    stats: dict[str, dict] = {}
    for r in train.groupBy("domain").agg(F.count("*").alias("n")).collect():  # a row for each domain
        empty = {f: math.log(0.5 / (r.n + 0.5 * (len(e) + 1))) for f, e in edges.items()}
        stats[r.domain] = {"n": r.n, "without": 0.0, "bins": {f: [empty[f]] * (len(edges[f]) + 1) for f in FEATURES}}
    for r in binned.collect():  # domains times features times bins
        s, f = stats[r.domain], FEATURES[r.k]
        s["bins"][f][r.bin] = math.log((r.n + 0.5) / (s["n"] + 0.5 * (len(edges[f]) + 1)))
    whole = sum(s["n"] for s in stats.values())
    known = [d for d in domains if d in stats]
    table: dict[str, list[float]] = {}
    if len(known) > 1:
        held = train.select("domain", F.explode(F.array_distinct(words(F.col("_text")))).alias("w")).filter("w <> ''")
        held = held.groupBy("w").agg(F.count("*").alias("n"), *(F.count_if(F.col("domain") == d).alias(f"n{k}") for k, d in enumerate(known))).filter(F.col("n").between(LEAST_DOCS, max(LEAST_DOCS, MOST_SHARE * whole)))
        share = [stats[d]["n"] / whole for d in known]
        odd = F.greatest(*(F.abs(F.col(f"n{k}") - F.col("n") * s) / F.sqrt(F.col("n") * (s * (1 - s))) for k, s in enumerate(share)))
        best = held.withColumn("odd", odd).filter(F.col("odd") >= LEAST_ODD).orderBy(F.col("odd").desc(), "w").limit(WORDS).collect()  # at most WORDS rows
        for r in best:
            with_it = {d: (r[f"n{k}"] + 0.5) / (stats[d]["n"] + 1) for k, d in enumerate(known)}
            for d, p in with_it.items():
                stats[d]["without"] += math.log(1 - p)
            table[r.w] = [math.log(with_it[d] / (1 - with_it[d])) if d in with_it else 0.0 for d in domains]
    return Classifier(domains, edges, stats, table)


def _step(y: Column, p: Column, e: list, rate: float, least: tuple[int, float] | None) -> Column:
    """A step of the gradient, projected on rates of 0 and more, or of 1 and more where the domain at ``least[0]`` has a probability of ``least[1]``."""
    g = sum((F.element_at(p, k + 1) * v for k, v in enumerate(e)), F.lit(0.0))
    floor = F.lit(0.0) if least is None else F.when(F.element_at(p, least[0] + 1) >= least[1], 1.0).otherwise(0.0)
    return F.greatest(floor, y - rate * (g + PULL * (y - 1)))


def _replay(p: Column, past: list[list[float]], momentum: list[float], rate: float, ahead: bool, least: tuple[int, float] | None = None, start: Column | None = None) -> Column:
    """The rate after all ``past`` residuals; with ``ahead``, the point where the next residual is taken.

    ``start`` is the point (y, r) before the first of them, 1 and 1 if it is not given.
    """
    if not past:
        return F.lit(1.0) if start is None else start.getField("y" if ahead else "r")
    number = lambda x: f"{float(x)!r}D"
    steps = F.expr("array(" + ", ".join(f"named_struct('e', array({', '.join(map(number, e))}), 'm', {number(m)})" for e, m in zip(past, momentum)) + ")")
    n = len(past[0])

    def move(a: Column, s: Column) -> Column:
        new = _step(a.y, p, [F.element_at(s.e, k + 1) for k in range(n)], rate, least)
        return F.struct((new + s.m * (new - a.r)).alias("y"), new.alias("r"))

    one = F.struct(F.lit(1.0).alias("y"), F.lit(1.0).alias("r"))
    return F.aggregate(steps, one if start is None else start, move, lambda a: a.y if ahead else a.r)


def fit_rates(known: DataFrame, targets: dict[str, float], rounds: int = ROUNDS, close: float = 1e-4, least: tuple[int, float] | None = None) -> tuple[list[list[float]], list[float], float]:
    """Residuals (by target), momentum of each iteration and the step, over rows of tokens _n and memberships _p.

    The end is where, ``CALM`` times in a row, no residual moves by more than ``close`` of
    its domain's own target: at a turning point of the momentum one small move says
    little. Step and momentum follow the curvature: at most the largest row of the
    second moments of the memberships, at least the pull.
    """
    domains = sorted(targets)
    d = len(domains)
    p = [F.element_at("_p", k + 1) for k in range(d)]
    moments = [F.sum(F.col("_n") * p[j] * p[k]).alias(f"m{j}_{k}") for j in range(d) for k in range(d)]
    first = known.agg(F.sum("_n").alias("n"), *(F.sum(F.col("_n") * p[k]).alias(f"t{k}") for k in range(d)), *moments).first()
    whole = first.n or 0.0
    # Domains that no document can belong to have no share.
    share = [targets[x] if whole and first[f"t{k}"] > 0 else 0.0 for k, x in enumerate(domains)]
    share = [w / (sum(share) or 1.0) for w in share]
    scale = [max(w, 1e-3) for w in share]
    steep = max((sum(first[f"m{j}_{k}"] / math.sqrt(scale[j] * scale[k]) for k in range(d)) / whole for j in range(d)), default=1.0) if whole else 1.0
    past: list[list[float]] = []
    momentum: list[float] = []
    t, before, calm = 1.0, None, 0
    root, rate = math.sqrt(PULL / (steep + PULL)), 1 / (steep + PULL)
    saved, done, at = known, 0, None
    for _ in range(rounds if whole else 0):
        if len(past) - done == SAVE:  # the points so far are written, later rounds go on from there
            there = [_replay(F.col("_p"), past[done:], momentum[done:], rate, ahead, least, at).alias(n) for n, ahead in (("y", True), ("r", False))]
            before_it, saved = saved, stored(saved.select("_n", "_p", F.struct(*there).alias("_at")), "mix-points")
            if done:
                discard(before_it)
            done, at = len(past), F.col("_at")
        y = _replay(F.col("_p"), past[done:], momentum[done:], rate, True, least, at)
        rows = saved.select("_n", "_p", y.alias("_y"))
        got = rows.agg(*(F.sum(F.col("_y") * F.col("_n") * p[k]).alias(f"t{k}") for k in range(d))).first()
        e = [(got[k] / whole - share[k]) / scale[k] for k in range(d)]
        calm = calm + 1 if before is not None and all(abs(a - b) < close for a, b in zip(e, before)) else 0
        if calm == CALM:
            break
        nxt = (1 + math.sqrt(1 + 4 * t * t)) / 2
        past.append(e)
        momentum.append(min((t - 1) / nxt, (1 - root) / (1 + root)))
        t, before = nxt, e
    if done:
        discard(saved)
    return past, momentum, rate


def lifted(known: DataFrame, targets: dict[str, float], keep: str) -> dict[str, float]:
    """``targets`` with that of ``keep`` at its share of the tokens at least; the others share the rest as before."""
    k = sorted(targets).index(keep) + 1
    got = known.agg(F.sum("_n").alias("n"), F.sum(F.col("_n") * F.element_at("_p", k)).alias("own")).first()
    whole = sum(targets.values()) or 1.0
    share, others = targets[keep] / whole, whole - targets[keep]
    if not got.n or got.own / got.n <= share:
        return targets
    rest = 1 - got.own / got.n
    return {d: 1 - rest if d == keep else rest * (v / others if others else 1 / (len(targets) - 1)) for d, v in targets.items()}


def cells(rows: DataFrame, domains: list[str]) -> DataFrame:
    """Tokens _n and mean memberships _p of the grid's cells that hold documents."""
    grid = F.transform("_p", lambda x: F.round(x * GRID).cast("int"))
    sums = [F.sum(F.col("_n") * F.element_at("_p", k + 1)).alias(f"s{k}") for k in range(len(domains))]
    held = rows.filter("_n > 0").groupBy(grid.alias("_g")).agg(F.sum("_n").alias("_n"), *sums)
    return held.select("_n", F.array(*(F.col(f"s{k}") / F.col("_n") for k in range(len(domains)))).alias("_p"))


def mix(docs: DataFrame, labelled: DataFrame, targets: dict[str, float], keep: str | None = None, carry: list[str] | None = None, doubt: float = 0.5) -> DataFrame:
    """``docs`` with n_tokens, posteriors (domains in order of name), rate and copies.

    ``labelled`` has doc_id and domain; of several labels of one document the largest
    counts, and null ones don't. ``targets`` maps every domain to its weight. Null and
    empty texts have no tokens, so any rate is free and theirs follows from their
    probabilities as others' do. ``copies`` is the rate rounded down or up by a hash of
    doc_id and text, so that its mean is the rate. Domains without labelled documents
    get probability 0, and their targets take no part; without any labels all domains
    are equally likely. Documents that belong to ``keep`` with a probability of ``doubt`` or
    more get a rate of 1 at least, which the fit of all others makes up for, and its target
    is raised to its share of ``docs`` where it lies below.
    Of ``docs`` the columns ``carry`` (all, if not given) are returned, whatever their
    names; those named like the new ones are replaced.
    """
    new = ("n_tokens", "posteriors", "rate", "copies")
    carry = [c for c in (docs.columns if carry is None else carry) if c not in new]
    row = F.struct(*(F.col(f"`{c}`") for c in carry)) if carry else F.struct(F.lit(0).alias("_"))
    mixed = _mixed(docs, row, "text" in carry, labelled, targets, keep, doubt)
    return mixed.select(*(F.col("_row").getField(c).alias(c) for c in carry), *(F.col(k) for k in new))


def _mixed(docs: DataFrame, row: Column, inside: bool, labelled: DataFrame, targets: dict[str, float], keep: str | None, doubt: float) -> DataFrame:
    """_row (``row`` of ``docs``), n_tokens, posteriors, rate, copies; ``inside`` says that the row holds the text."""
    domains = sorted(targets)
    chance = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)) / float(1 << 30)
    rows = features(docs.select(row.alias("_row"), F.col("doc_id").cast("long").alias("doc_id"), "text", chance.alias("_chance")))
    # The text is stored once: in the row, or beside it.
    measured = stored(rows.select("_row", "doc_id", "_n", "_x", "_chance", *([] if inside else ["text"])), "mix-features")
    text = F.coalesce(F.col("_row").getField("text") if inside else F.col("text"), F.lit(""))
    known = fit_classifier(measured.withColumn("_text", text), labelled, domains)
    probable = stored(known.scored(measured, text).select("_row", "_n", "_chance", "_p"), "mix-memberships")
    discard(measured)
    grid = stored(cells(probable, domains), "mix-cells")
    least = None if keep is None else (domains.index(keep), doubt)
    past, momentum, step = fit_rates(grid, targets if keep is None else lifted(grid, targets, keep), least=least)
    discard(grid)
    probable = probable.withColumn("_r", _replay(F.col("_p"), past, momentum, step, False, least))
    copies = F.floor(F.col("_r") + F.col("_chance")).cast("long")
    return probable.select("_row", F.col("_n").cast("long").alias("n_tokens"), F.col("_p").alias("posteriors"), F.col("_r").alias("rate"), copies.alias("copies"))


def resample(docs: DataFrame, labelled: DataFrame, targets: dict[str, float], keep: str | None = None, doubt: float = 0.5) -> DataFrame:
    """``docs``, all columns unchanged, each row as often as mix() says."""
    mixed = _mixed(docs, F.struct("*"), True, labelled, targets, keep, doubt)
    many = F.explode_outer(F.array_repeat(F.lit(1), F.col("copies").cast("int"))).alias("_copy")
    return mixed.select("_row", many).filter("_copy IS NOT NULL").select("_row.*")
