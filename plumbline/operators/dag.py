"""Evaluation graphs compiled to columns.

A graph has routers (a key picks the next nodes), enrichers (always go on, may update
the context) and arbiters (give the verdict). It is checked and ordered on the
driver; run() then adds, for each node in order, whether it is reached, its output,
its error and its cost, so a table of contexts is judged in one projection. Nodes are
functions from the context's columns to a column; they are evaluated by Catalyst,
only where they are reached.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Cost:
    """Rates for tokens in and out, and what a call costs and takes."""

    input_rate: float = 0.0
    output_rate: float = 0.0
    fixed: float = 0.0
    latency: float = 0.0

    def __add__(self, other: Cost) -> Cost:
        return Cost(self.input_rate + other.input_rate, self.output_rate + other.output_rate, self.fixed + other.fixed, self.latency + other.latency)


Context = dict[str, Column]  # prompt, response, metadata
Rule = Callable[[Context], Column]


def _merged(new: Column, old: Column) -> Column:
    """A map with the entries of both, the new ones first."""
    return F.map_from_entries(F.concat(F.map_entries(new), F.filter(F.map_entries(old), lambda e: ~F.map_contains_key(new, e.key))))


def _conflict(a: Column, b: Column) -> Column:
    """Whether two maps give one key different values."""
    return F.exists(F.map_entries(a), lambda e: F.coalesce(F.try_element_at(b, e.key) != e.value, F.lit(False)))


def no_tokens(_: Context) -> Column:
    return F.lit(0)


@dataclass
class Node:
    name: str
    rule: Rule
    cost: Cost = Cost()
    tokens_in: Rule = no_tokens
    tokens_out: Rule = no_tokens
    error: Rule | None = None

    def targets(self) -> list[str]:
        return []


@dataclass
class Router(Node):
    """rule gives a key; routes name the nodes or verdicts for each key, default those for any other."""

    routes: dict[str, list[str]] = field(default_factory=dict)
    default: list[str] | None = None

    def targets(self) -> list[str]:
        return [t for ts in self.routes.values() for t in ts]


@dataclass
class Enricher(Node):
    """Goes on to all its next nodes; updates(context) may give a new prompt, response or metadata entries."""

    next: list[str] = field(default_factory=list)
    updates: Callable[[Context, Column], dict[str, Column]] | None = None

    def targets(self) -> list[str]:
        return self.next


@dataclass
class Arbiter(Node):
    """rule gives the verdict."""


class GraphError(ValueError):
    pass


def metadata_of(df: DataFrame, json_column: str | None = None, columns: list[str] | None = None, but: tuple[str, ...] = ("prompt", "response")) -> Column:
    """A map of a row's metadata: of a column of JSON objects (nothing for text that is none), of the named columns, or of all others."""
    if json_column is not None:
        return F.coalesce(F.from_json(json_column, "map<string,string>"), F.create_map().cast("map<string,string>"))
    names = [c for c in df.columns if c not in but] if columns is None else columns
    return F.create_map(*[x for c in names for x in (F.lit(c), F.col(f"`{c}`").cast("string"))]).cast("map<string,string>")


class Composer:
    def __init__(self, name: str, nodes: list[Node], verdicts: list[str]):
        self.name, self.nodes, self.verdicts = name, {n.name: n for n in nodes}, list(verdicts)
        if len(self.nodes) != len(nodes):
            raise GraphError("two nodes have one name")
        self._check()
        self.order = self._sorted()

    def _check(self) -> None:
        for n in self.nodes.values():
            routes = list(n.routes.values()) + [n.default or []] if isinstance(n, Router) else [n.targets()]
            for targets in routes:
                for t in targets:
                    if t not in self.nodes and t not in self.verdicts:
                        raise GraphError(f"{n.name} goes to {t}, which isn't there")
                if sum(t in self.verdicts for t in targets) > 1:
                    raise GraphError(f"{n.name} goes to more than one verdict at once")

    def parents(self, name: str) -> list[str]:
        return [n.name for n in self.nodes.values() if name in n.targets()]

    def roots(self) -> list[str]:
        """Nodes that no route names; a node that is only some router's default is one of them and always runs."""
        return [n for n in self.nodes if not self.parents(n)]

    def _sorted(self) -> list[str]:
        waiting = {n: len(self.parents(n)) for n in self.nodes}
        ready, out = [n for n, k in waiting.items() if not k], []
        while ready:
            n = ready.pop(0)
            out.append(n)
            for t in dict.fromkeys(self.nodes[n].targets()):
                if t in waiting:
                    waiting[t] -= 1
                    if not waiting[t]:
                        ready.append(t)
        if len(out) < len(self.nodes):
            raise GraphError(f"there is a cycle among {sorted(set(self.nodes) - set(out))}")
        return out

    def potential_costs(self) -> dict[str, Cost]:
        """Cost of each path, for every choice of every router."""
        routers = [n for n in self.nodes.values() if isinstance(n, Router)]
        out = {}
        for keys in product(*[list(r.routes) for r in routers]):
            chosen = dict(zip((r.name for r in routers), keys, strict=True))
            reached, path, total = set(self.roots()), [], Cost()
            for name in self.order:
                if name in reached:
                    n = self.nodes[name]
                    path.append(name)
                    total = total + n.cost
                    reached |= set(n.routes[chosen[name]] if isinstance(n, Router) else n.targets())
            out[" -> ".join(path)] = total
        return out

    def run(self, df: DataFrame, prompt: str = "prompt", response: str = "response", metadata: str | None = None, on_abort: str = "raise", trace: bool = False) -> DataFrame:
        """df with {name}_output, {name}_error, {name}_cost (a struct) and, with trace, {name}_reached.

        metadata: a map column. A key without a route, or an end without a verdict,
        is an error of the whole run, or with on_abort="column" of the row.
        """
        pre = f"_{self.name}_"
        given = set(df.columns)
        empty = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
        out = df.withColumn(f"{pre}ctx", F.struct(F.col(prompt).alias("prompt"), F.col(response).alias("response"), (F.col(metadata) if metadata else empty).alias("metadata")))
        out = out.withColumn(f"{pre}done", F.lit(False)).withColumn(f"{pre}error", F.lit(None).cast("string")).withColumn(f"{pre}verdict", F.lit(None).cast("string"))
        abort = lambda text: F.raise_error(text).cast("string") if on_abort == "raise" else text
        updated: dict[str, str] = {}
        costs: list[tuple[str, Cost]] = []
        for name in self.order:
            node, ctx, done = self.nodes[name], F.col(f"{pre}ctx"), F.col(f"{pre}done")
            if self.parents(name):
                routed = F.lit(False)
                for p in self.parents(name):
                    routed |= F.col(f"{pre}{p}_to_{name}")
                reach = routed & ~done
            else:
                reach = ~done
            out = out.withColumn(f"{pre}{name}_reached", reach)
            reach = F.col(f"{pre}{name}_reached")
            news = [updated[p] for p in self.parents(name) if p in updated]
            if news:
                first = F.coalesce(*[F.col(c) for c in news])
                meta = F.coalesce(*[F.col(f"{c}.metadata") for c in news])
                clash = F.lit(False)
                for c in news:
                    other = F.col(c)
                    clash |= F.coalesce((other.prompt != first.prompt) | (other.response != first.response), F.lit(False))
                    clash |= F.coalesce(_conflict(other.metadata, meta), F.lit(False))
                    meta = F.when(other.isNotNull(), _merged(other.metadata, meta)).otherwise(meta)
                out = out.withColumn(f"{pre}ctx", F.when(reach & first.isNotNull(), F.struct(first.prompt.alias("prompt"), first.response.alias("response"), meta.alias("metadata"))).otherwise(ctx))
                out = out.withColumn(f"{pre}error", F.when(reach & clash, F.lit(f"{name}: the contexts of its parents differ")).otherwise(F.col(f"{pre}error")))
            now = {k: F.col(f"{pre}ctx.{k}") for k in ("prompt", "response", "metadata")}
            if node.error is not None:
                out = out.withColumn(f"{pre}error", F.coalesce(F.col(f"{pre}error"), F.when(reach, F.concat(F.lit(f"{name}: "), node.error(now)))))
            runs = reach & F.col(f"{pre}error").isNull()
            out = out.withColumn(f"{pre}{name}_runs", runs)
            runs = F.col(f"{pre}{name}_runs")
            out = out.withColumn(f"{pre}{name}_value", F.when(runs, node.rule(now)))
            value = F.col(f"{pre}{name}_value")
            used = lambda c, runs=runs: F.when(runs, c.cast("double")).otherwise(0.0)
            cost = F.struct(used(node.tokens_in(now) * node.cost.input_rate).alias("input"), used(node.tokens_out(now) * node.cost.output_rate).alias("output"), used(F.lit(node.cost.fixed)).alias("fixed"), used(F.lit(node.cost.latency)).alias("latency"))
            out = out.withColumn(f"{pre}{name}_cost", cost)
            costs.append((f"{pre}{name}_cost", node.cost))
            verdict = F.lit(None).cast("string")
            if isinstance(node, Arbiter):
                verdict = F.when(runs, value.cast("string"))
            elif isinstance(node, Router):
                goes = {t: F.lit(False) for t in node.targets() + (node.default or [])}
                for key, targets in node.routes.items():
                    for t in targets:
                        goes[t] |= F.coalesce(value == F.lit(key), F.lit(False))
                other = runs & ~F.coalesce(value.isin(list(node.routes)), F.lit(False))
                for t in node.default or []:
                    goes[t] |= other
                if node.default is None:
                    text = F.concat(F.lit(f"{name} has no route for "), F.coalesce(value.cast("string"), F.lit("null")))
                    out = out.withColumn(f"{pre}error", F.when(other, abort(text)).otherwise(F.col(f"{pre}error")))
                for t, c in goes.items():
                    if t in self.verdicts:
                        verdict = F.when(runs & c, F.lit(t)).otherwise(verdict)
                    else:
                        out = out.withColumn(f"{pre}{name}_to_{t}", runs & c)
            else:
                for t in node.targets():
                    if t in self.verdicts:
                        verdict = F.when(runs, F.lit(t)).otherwise(verdict)
                    else:
                        out = out.withColumn(f"{pre}{name}_to_{t}", runs)
                if isinstance(node, Enricher) and node.updates is not None:
                    new = node.updates(now, value)
                    more = new.get("metadata")
                    merged = now["metadata"] if more is None else _merged(more, now["metadata"])
                    text = lambda k, new=new, now=now: now[k] if k not in new else F.when(new[k] != "", new[k]).otherwise(now[k])
                    out = out.withColumn(f"{pre}{name}_ctx", F.when(runs, F.struct(text("prompt").alias("prompt"), text("response").alias("response"), merged.alias("metadata"))))
                    updated[name] = f"{pre}{name}_ctx"
            out = out.withColumn(f"{pre}verdict", F.coalesce(F.col(f"{pre}verdict"), verdict))
            out = out.withColumn(f"{pre}done", F.col(f"{pre}verdict").isNotNull() | F.col(f"{pre}error").isNotNull())
        lost = ~F.col(f"{pre}done")
        out = out.withColumn(f"{pre}error", F.when(lost, abort(F.lit("the graph ended without a verdict"))).otherwise(F.col(f"{pre}error")))
        total = F.struct(*[sum((F.col(f"{c}.{k}") for c, _ in costs), F.lit(0.0)).alias(k) for k in ("input", "output", "fixed", "latency")])
        seen = [F.array_compact(F.array(*[F.when(F.col(f"{pre}{n}_runs"), F.lit(n)) for n in self.order])).alias(f"{self.name}_reached")] if trace else []
        return out.select(*[c for c in out.columns if c in given], F.col(f"{pre}verdict").alias(f"{self.name}_output"), F.col(f"{pre}error").alias(f"{self.name}_error"), total.alias(f"{self.name}_cost"), *seen)
