"""Greedy choice of sources to multiply until two label counts and the counts of aspect pairs reach their targets.

The rule, one draft after another: of all sources that help a count which is short, take the one
that helps most targets, then the one used least, then the one whose targets lack most, then by fold, product and id.
Sources with the same two labels (a cell) help alike, so each use of them has a fixed place in its cell. Only the cells' counts
decide how far the choice goes on within each cell; the order of rows is looked up where cells tie.
So the choice runs on counts, in rounds, and the rows are picked at the end by their places.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Callable
from dataclasses import dataclass, field
from heapq import heappop, heappush

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewspark.operators.ordering import kept, numbered

#: Rows whose order is fetched at once where cells tie.
PAGE = 1000
#: Picks and states that a period is looked for in.
STEPS, STATES = 48, 4000
ORDER = ["fold", "product_id", "review_id"]
Cell = tuple[int, int]


@dataclass
class Fill:
    """``picks``: review_id, use (how often the source was used before), in one row a draft; what could not be filled."""

    picks: DataFrame
    counts: dict[int, int]
    text_counts: dict[int, int]
    pair_counts: dict[tuple[int, int], int] = field(default_factory=dict)
    unfillable: list[dict] = field(default_factory=list)


def periods(deficit: list[int], share: list[list[int]]) -> list[list[int]]:
    """Picks of each queue after which all tie-breaks have come to the same state and the leading queues stand as before, shortest first."""
    n, out = len(deficit), []
    front = {(0,) * n}
    for _ in range(STEPS):
        after = set()
        for s in front:
            now = [deficit[i] - sum(s[j] * share[i][j] for j in range(n) if s[j]) for i in range(n)]
            top = max(now)
            after.update(s[:i] + (s[i] + 1,) + s[i + 1 :] for i in range(n) if now[i] == top)
        if len(after) > STATES:
            break
        front = after
        if len(front) == 1:
            s = next(iter(front))
            fall = [sum(s[j] * share[i][j] for j in range(n)) for i in range(n)]
            own = {fall[i] for i in range(n) if s[i]}
            if len(own) == 1 and max(fall) == max(own):
                out.append(list(s))
    return out


def repeats(deficit: list[int], share: list[list[int]], picks: list[int], room: list[int], lack: list[tuple[int, int]]) -> int:
    """How often a period can run before a queue ends, a target is met, or a queue outside comes up.

    ``lack``: of each target what it lacks, and what a period takes from it.
    """
    n = len(deficit)
    fall = [sum(picks[j] * share[i][j] for j in range(n)) for i in range(n)]
    most, top = max(fall), max(deficit)
    k = min((room[i] - 1) // picks[i] for i in range(n) if picks[i])
    k = min([k, *((left - 1) // taken for left, taken in lack if taken)])
    for i in range(n):
        if not picks[i] and fall[i] < most:
            k = min(k, (top - deficit[i] - fall[i] - 1) // (most - fall[i]))
    return max(0, k)


class Phase:
    """Queues at one level of use among which a draft's source is chosen, until a queue ends or a target is met."""

    def __init__(self, queues: list[tuple[tuple[int, ...], int]], lack: dict[int, int], head: Callable[[int, int], tuple]) -> None:
        """``queues``: the targets that each queue serves, and its rows; ``head(queue, place)``: what its rows are ordered by."""
        self.targets, self.room = [q[0] for q in queues], [q[1] for q in queues]
        self.lack, self.head, self.taken = lack, head, [0] * len(queues)
        self.share = [[len(set(a) & set(b)) for b in self.targets] for a in self.targets]

    def deficit(self) -> list[int]:
        return [sum(self.lack[t] for t in ts) for ts in self.targets]

    def take(self, picks: list[int], times: int) -> None:
        for i, n in enumerate(picks):
            self.taken[i] += n * times
            self.room[i] -= n * times
            for t in self.targets[i]:
                self.lack[t] -= n * times

    def times(self, now: list[int], picks: list[int]) -> int:
        used: Counter = Counter()
        for n, ts in zip(picks, self.targets, strict=True):
            used.update({t: n for t in ts})
        return repeats(now, self.share, picks, self.room, [(self.lack[t], u) for t, u in used.items()])

    def run(self) -> list[int]:
        n = len(self.targets)
        known: dict[tuple, list[list[int]]] = {}
        while all(self.room) and all(self.lack[t] > 0 for ts in self.targets for t in ts):
            now = self.deficit()
            top = max(now)
            near = tuple(top - x for x in now)
            if near not in known:
                known[near] = periods(now, self.share)
            times, picks = max(((self.times(now, x), x) for x in known[near]), key=lambda y: y[0] * sum(y[1]), default=(0, []))
            if times:
                self.take(picks, times)
                continue
            tied = [i for i in range(n) if now[i] == top]
            one = tied[0] if len(tied) == 1 else min(tied, key=lambda i: self.head(i, self.taken[i]))
            self.take([int(i == one) for i in range(n)], 1)
        return self.taken


class Uses:
    """Every use that sources of a cell can still be put to, as far as targets could need it: ``cell, use, fold, product_id, review_id, at``."""

    def __init__(self, sources: DataFrame, need: dict[Cell, int]) -> None:
        """``sources``: review_id, label, text_label, fold, product_id, used, capacity; ``need``: the most that a cell is asked for."""
        spark = sources.sparkSession
        able = sources.where("capacity > 0")
        self.size: dict[Cell, dict[int, int]] = defaultdict(Counter)  # cell -> use -> rows
        for r in able.groupBy("label", "text_label", "used", "capacity").count().collect():
            for use in range(r["used"], r["used"] + min(r["capacity"], need.get((r["label"], r["text_label"]), 0))):
                self.size[r["label"], r["text_label"]][use] += r["count"]
        last = []
        for cell, levels in self.size.items():
            held = 0
            for use in sorted(levels):
                if held >= need[cell]:
                    del levels[use]
                elif held + levels[use] >= need[cell]:
                    last.append((*cell, use))
                held += levels.get(use, 0)
            if held < need[cell]:
                last.append((*cell, max(levels)))
        bound = spark.createDataFrame(last, "label int, text_label int, last int")  # a row a cell
        levels = F.explode(F.expr("sequence(used, least(last, used + capacity - 1))"))
        rows = able.join(F.broadcast(bound), ["label", "text_label"]).where("used <= last").select("label", "text_label", levels.alias("use"), *ORDER)
        self.rows = kept(numbered(rows, ["label", "text_label", "use"], ORDER), "fill-uses")

    def queue(self, members: list[tuple[Cell, int]], use: int) -> DataFrame:
        """The uses at one level of some cells from a place on each, with their places ``n`` in the common order."""
        some = [self.rows.where((F.col("label") == c[0]) & (F.col("text_label") == c[1]) & (F.col("use") == use) & (F.col("at") >= start)).withColumn("n", F.col("at") - start) for c, start in members]
        if len(some) == 1:
            return some[0]
        both = some[0].drop("n")
        for x in some[1:]:
            both = both.unionByName(x.drop("n"))
        return kept(numbered(both.withColumn("all", F.lit(0)), ["all"], ORDER, "n"), "fill-queue")

    def picked(self, taken: dict[tuple[Cell, int], int]) -> DataFrame:
        """The first uses of each cell and level."""
        rows = [(*cell, use, n) for (cell, use), n in taken.items() if n]
        want = self.rows.sparkSession.createDataFrame(rows, "label int, text_label int, use int, n long")  # a row a level of a cell
        return self.rows.join(F.broadcast(want), ["label", "text_label", "use"]).where("at < n").select("review_id", "use")


def gains(label: Column, text_label: Column, lack: dict[int, int], text_lack: dict[int, int]) -> tuple[Column, Column]:
    """Of a source by its two labels: how many of its targets are short, and how many rows they lack together."""
    short = lambda c, of: F.greatest(F.lit(0), F.coalesce(*[F.when(c == k, F.lit(n)) for k, n in of.items()], F.lit(0)))
    a, b = short(label, lack), short(text_label, text_lack)
    return (a > 0).cast("int") + (b > 0).cast("int"), a + b


def placed(row: tuple) -> tuple:
    """A row's values in an order with nulls first."""
    return tuple((x is not None, x if x is not None else 0) for x in row)


def both_targets(sources: DataFrame, counts: dict[int, int], text_counts: dict[int, int], target: int, text_target: int) -> Fill:
    """Choose sources until both label counts reach their targets (0 to 3 in each).

    ``sources``: review_id, label, text_label, fold, product_id, used (drafts it has), capacity (further
    ones it can give). What stays short is in ``unfillable``. Equals the loop of single choices.
    """
    # Targets are numbered: labels as they are, text labels from 4 on.
    lack = {i: target - counts.get(i, 0) for i in range(4)} | {4 + i: text_target - text_counts.get(i, 0) for i in range(4)}
    uses = Uses(sources, {(a, b): max(0, lack[a], lack[4 + b]) for a in range(4) for b in range(4)})
    left = {c: dict(levels) for c, levels in uses.size.items()}
    taken: dict[tuple[Cell, int], int] = Counter()
    while True:
        gain = {c: (lack[c[0]] > 0) + (lack[4 + c[1]] > 0) for c, levels in left.items() if levels}
        tier = max(gain.values(), default=0)
        if not tier:
            break
        cells = sorted(c for c, g in gain.items() if g == tier)
        use = min(min(left[c]) for c in cells)
        queues: dict[tuple[int, ...], list[Cell]] = defaultdict(list)
        for c in cells:
            if min(left[c]) == use:
                queues[tuple(t for t in (c[0], 4 + c[1]) if lack[t] > 0)].append(c)
        members = list(queues.items())
        tables: dict[int, DataFrame] = {}
        pages: dict[int, tuple[int, list[tuple]]] = {}

        def table(i: int, members: list = members, use: int = use, tables: dict = tables) -> DataFrame:
            if i not in tables:
                tables[i] = uses.queue([(c, taken[c, use]) for c in members[i][1]], use)
            return tables[i]

        def head(i: int, n: int, pages: dict = pages, table: Callable = table) -> tuple:
            start, rows = pages.get(i, (0, []))
            if not start <= n < start + len(rows):
                start, rows = n, [placed(r) for r in table(i).where(F.col("n").between(n, n + PAGE - 1)).orderBy("n").select(*ORDER).collect()]
                pages[i] = start, rows
            return rows[n - start]

        phase = Phase([(ts, sum(left[c][use] for c in cs)) for ts, cs in members], {t: lack[t] for ts in queues for t in ts}, head)
        for i, n in enumerate(phase.run()):
            cs = members[i][1]
            if len(cs) == 1 or not n:
                split = {cs[0]: n}
            elif n == sum(left[c][use] for c in cs):
                split = {c: left[c][use] for c in cs}
            else:
                split = {(r["label"], r["text_label"]): r["count"] for r in table(i).where(F.col("n") < n).groupBy("label", "text_label").count().collect()}
            for c, k in split.items():
                taken[c, use] += k
                left[c][use] -= k
                lack[c[0]] -= k
                lack[4 + c[1]] -= k
                if not left[c][use]:
                    del left[c][use]
    short = [{"target": "ground_truth" if t < 4 else "text_label", "label": t % 4, "lacks": n} for t, n in sorted(lack.items()) if n > 0]
    return Fill(uses.picked(taken), {i: target - lack[i] for i in range(4)}, {i: text_target - lack[4 + i] for i in range(4)}, {}, short)


def one_target(sources: DataFrame, counts: dict[int, int], target: int) -> DataFrame:
    """Choose sources until each label's count reaches the target: ``label, turn, review_id, use``, turns from 1 in each label."""
    lack = {c: max(0, target - n) for c, n in counts.items()}
    uses = Uses(sources.withColumn("text_label", F.lit(0)), {(c, 0): n for c, n in lack.items()})
    before = []
    for cell, levels in uses.size.items():
        held = 0
        for use in sorted(levels):
            before.append((*cell, use, held, lack[cell[0]]))
            held += levels[use]
    level = sources.sparkSession.createDataFrame(before, "label int, text_label int, use int, before long, most long")
    turn = F.col("before") + F.col("at") + 1
    return uses.rows.join(F.broadcast(level), ["label", "text_label", "use"]).withColumn("turn", turn).where("turn <= most").select("label", "turn", "review_id", "use")


def fill_pairs(sources: DataFrame, pairs: DataFrame, have: dict[tuple[int, int], int], minimum: int) -> tuple[list[dict], dict[tuple[int, int], int], list[dict]]:
    """Choose authentic sources until each (aspect, sentiment) is held ``minimum`` times, the rarest pairs first.

    Each choice counts for all pairs that its source holds. At most ``minimum`` choices a pair are made, and
    as many of its holders, and those chosen before, are looked at: the first by use, fold, product and id. Returns the choices (source
    rows with their ``use``), the counts and the pairs that stay short.
    """
    code = (F.col("aspect") * 3 + F.col("sentiment")).cast("int")
    held = pairs.select("review_id", code.alias("code")).groupBy("review_id").agg(F.collect_set("code").alias("codes"))  # 30 at most
    able = kept(sources.where("label = 0 and capacity > 0").join(held, "review_id"), "fill-holders")
    counts = {(a, s): have.get((a, s), 0) for a in range(10) for s in range(3)}
    extra: dict[str, int] = Counter()
    facts: dict[str, dict] = {}
    picks, short = [], []
    for a, s in sorted(counts, key=lambda p: counts[p]):
        if counts[a, s] >= minimum:
            continue
        own = able.where(F.array_contains("codes", a * 3 + s)).orderBy("used", *[F.col(c).asc_nulls_first() for c in ORDER])
        few = {r["review_id"]: r.asDict() for r in own.limit(minimum - counts[a, s] + len(extra)).collect()}
        few |= {k: f for k, f in facts.items() if a * 3 + s in f["codes"]}
        heap: list[tuple] = []
        for k, f in few.items():
            if extra[k] < f["capacity"]:
                heappush(heap, (f["used"] + extra[k], placed(tuple(f[c] for c in ORDER)), k))
        while counts[a, s] < minimum:
            if not heap:
                short.append({"aspect": a, "sentiment": s, "count": counts[a, s], "target": minimum})
                break
            use, key, k = heappop(heap)
            f = facts.setdefault(k, few[k])
            picks.append(f | {"use": use})
            extra[k] += 1
            for c in f["codes"]:
                counts[divmod(c, 3)] += 1
            if extra[k] < f["capacity"]:
                heappush(heap, (use + 1, key, k))
    return picks, counts, short


def fill_targets(sources: DataFrame, pairs: DataFrame, counts: dict[int, int], text_counts: dict[int, int], pair_counts: dict[tuple[int, int], int], minimum: int, target: int = 0) -> Fill:
    """First the aspect pairs up to ``minimum``, then both labels up to ``target`` or the largest class, if that is more."""
    picks, now, short = fill_pairs(sources, pairs, pair_counts, minimum)
    counts, text_counts = Counter(counts), Counter(text_counts)
    for p in picks:
        counts[p["label"]] += 1
        text_counts[p["text_label"]] += 1
    extra = Counter(p["review_id"] for p in picks)
    spark = sources.sparkSession
    more = spark.createDataFrame(list(extra.items()), "review_id string, extra int")  # minimum x 30 rows at most
    rest = sources.join(F.broadcast(more), "review_id", "left").fillna(0, ["extra"])
    rest = rest.select("review_id", "label", "text_label", "fold", "product_id", (F.col("used") + F.col("extra")).alias("used"), (F.col("capacity") - F.col("extra")).alias("capacity"))
    goal, text_goal = max(target, *(counts[i] for i in range(4))), max(target, *(text_counts[i] for i in range(4)))
    out = both_targets(rest, counts, text_counts, goal, text_goal)
    first = spark.createDataFrame([(p["review_id"], p["use"]) for p in picks], "review_id string, use int")
    return Fill(first.unionByName(out.picks), out.counts, out.text_counts, now, short + out.unfillable)
