"""Declarative flows: a dict of nodes and edges becomes one lazy DataFrame per node.

Node types: input, filter, join, union, transform and output. Nothing runs
until a sink is written or a result is read, so Catalyst plans each sink as a
whole. The exception is an outer join of large tables, which looks for hot
keys when it is built.
"""

import time
from dataclasses import dataclass
from graphlib import CycleError, TopologicalSorter

from pyspark.sql import functions as F

from ..errors import CycleInFlowError, FlowError
from ..operators.conditions import safe_filter
from ..operators.relational import join_frames, left_and_right, transform_columns, union_frames
from ..sources.files import read_dataset, write_dataset, write_through
from ..sources.memory import read_memory, write_memory
from ..sources.paths import remove, scoped_path, shared_dir

LOG_SCHEMA = "node_id string, status string, duration_ms double, rows long, error string"


@dataclass(frozen=True)
class Place:
    """Where the datasets of a flow live: files under ``base``, or named tables without one."""

    tenant: str
    project: str | None = None
    base: str | None = None

    def read(self, spark, key):
        if self.base is None:
            return read_memory(spark, self.tenant, key, self.project)
        return read_dataset(spark, self.path(key))

    def path(self, key):
        return scoped_path(self.base, self.tenant, key, self.project)

    def write(self, spark, df, key):
        """Write a sink and hand back what was written."""
        if self.base is None:
            write_memory(df, self.tenant, key, self.project)
            return self.read(spark, key)
        path = self.path(key)
        write_dataset(df, path)
        return read_dataset(spark, path, schema=df.schema)


def _only(inputs, kind):
    frames = list(inputs.values())
    if len(frames) != 1:
        raise ValueError(f"{kind} nodes take exactly one input, got {len(frames)}")
    return frames[0]


def _input(config, inputs, spark, place):
    if inputs:
        raise ValueError("input nodes take no input")
    return place.read(spark, config.get("key") or config.get("path", ""))


def _filter(config, inputs, spark, place):
    return safe_filter(_only(inputs, "filter"), config.get("condition", ""))


def _join(config, inputs, spark, place):
    left, right = left_and_right(inputs)
    return join_frames(left, right, config.get("on", []), config.get("how", "inner"),
                       hot_share=config.get("hot_share", 0.02), hot_sides=config.get("hot_sides"))


def _union(config, inputs, spark, place):
    return union_frames(*inputs.values(), allow_missing=config.get("allow_missing", False))


def _transform(config, inputs, spark, place):
    return transform_columns(
        _only(inputs, "transform"), config.get("select_columns"), config.get("rename_columns"),
        config.get("drop_columns"))


def _output(config, inputs, spark, place):
    return _only(inputs, "output")


KINDS = {
    "input": _input, "input_csv": _input, "input_parquet": _input,
    "filter": _filter, "join": _join, "union": _union, "transform": _transform,
    "output": _output, "output_csv": _output, "output_parquet": _output,
}


class Flow:
    """A checked spec (its shape is a fixed value): ``{"nodes": [{"id", "type", "config"}], "edges": [{"source", "target", "target_port"}]}``."""

    def __init__(self, spec):
        self.kind, self.config, self.feeds = {}, {}, {}
        for node in spec.get("nodes", []):
            data = node.get("data", {})
            kind = data.get("type") or node.get("type")
            if node["id"] in self.kind:
                raise ValueError(f"two nodes with the id {node['id']!r}")
            if kind not in KINDS:
                raise ValueError(f"unknown type {kind!r} of node {node['id']!r}")
            self.kind[node["id"]] = kind
            self.config[node["id"]] = node.get("config") or data.get("config") or {}
            self.feeds[node["id"]] = {}
        for edge in spec.get("edges", []):
            source, target = edge["source"], edge["target"]
            for end in (source, target):
                if end not in self.kind:
                    raise ValueError(f"edge to an unknown node: {end!r}")
            feeds = self.feeds[target]
            port = edge.get("target_port") or edge.get("targetHandle") or f"input_{len(feeds)}"
            if port in feeds:
                raise ValueError(f"two edges into port {port!r} of node {target!r}")
            feeds[port] = source
        targets = [self._key(n) for n, kind in self.kind.items() if kind.startswith("output")]
        if len(targets) > len(set(targets)):
            raise ValueError(f"two outputs write one dataset: {sorted(k for k in targets if targets.count(k) > 1)[0]!r}")
        try:
            self.order = list(TopologicalSorter(
                {n: feeds.values() for n, feeds in self.feeds.items()}).static_order())
        except CycleError as error:
            raise CycleInFlowError(f"nodes in a circle: {error.args[1]}") from error

    def _key(self, node):
        return (self.config[node].get("key") or self.config[node].get("path", "")).strip().strip("/")

    def ancestors(self, node):
        if node not in self.kind:
            raise ValueError(f"no node {node!r} in the flow")
        wanted, stack = set(), [node]
        while stack:
            current = stack.pop()
            if current not in wanted:
                wanted.add(current)
                stack.extend(self.feeds[current].values())
        return wanted

    def outputs(self):
        return [n for n in self.order if self.kind[n].startswith("output")]

    def twins(self, frames):
        """Nodes that compute what an earlier one does, by node id: that earlier node.

        Spark compares the plans, so the same work written in another way is
        found too. It does not compare names of columns; those must be equal.
        """
        first, same = {}, {}
        for node in self.order:
            if node not in frames or self.kind[node].startswith(("input", "output")):
                continue
            alike = first.setdefault((frames[node].semanticHash(), *frames[node].columns), [])
            for other in alike:
                if frames[other].schema == frames[node].schema and frames[other].sameSemantics(frames[node]):
                    same[node] = other
                    break
            else:
                alike.append(node)
        return same

    def shared(self, same=None):
        """Computed nodes from which the ways to different sinks part; ``same`` are twins that count as one node."""
        same = same or {}
        reaches = {n: set() for n in self.order}
        takers = {n: [] for n in self.order}
        # a twin has no way of its own: its takers take the first node's result
        for target in reversed(self.order):
            if self.kind[target].startswith("output"):
                reaches[target].add(target)
            if target in same:
                continue
            for source in {same.get(n, n) for n in self.feeds[target].values()}:
                takers[source].append(target)
                reaches[source] |= reaches[target]
        return {
            n for n in self.order
            if not self.kind[n].startswith(("input", "output"))
            and len({frozenset(reaches[t]) for t in takers[n] if reaches[t]}) > 1
        }

    def build(self, spark, place, only=None, after=None, made_before=None, same=None):
        """Lazy DataFrames by node id; ``after`` may replace each one as it is made.

        ``made_before`` are frames of an earlier build: nodes whose inputs are
        still those are not built again. A twin in ``same`` takes the frame of
        the node that it repeats. A failure carries the log: the nodes that were made, then the failed one.
        """
        frames, log = {}, []
        for node in self.order:
            if only is not None and node not in only:
                continue
            inputs = {port: frames[source] for port, source in self.feeds[node].items()}
            begun = time.perf_counter()
            try:
                if same and node in same:
                    frames[node] = frames[same[node]]
                else:
                    feeds = self.feeds[node].values()
                    if made_before and all(frames[n] is made_before[n] for n in feeds):
                        made = made_before[node]
                    else:
                        made = KINDS[self.kind[node]](self.config[node], inputs, spark, place)
                    frames[node] = after(node, made) if after else made
            except Exception as error:
                raise FlowError(f"node {node!r} failed: {error}", [*log, _failed(node, error, _since(begun))]) from error
            log.append((node, "succeeded", _since(begun), None, None))
        return frames

    def preview(self, spark, place, node, n=100, order=None):
        """Some n rows of a node, or its first ones by ``order``.

        Only the node's ancestors are planned and no sink is written.
        """
        made = self.build(spark, place, self.ancestors(node))[node]
        return (made.orderBy(*order) if order else made).limit(n)

    def node_counts(self, spark, place):
        """Exact row count of every node, as one query (node_id, rows)."""
        return _counts(self.build(spark, place))

    def run(self, spark, place, count_all=False):
        """Write every sink; returns ``(outputs, log)``.

        Outputs are re-read from what was written; without a base path they
        become named tables of the session. The log has one row per
        node; sinks carry the number of rows they wrote. ``count_all`` adds
        the rows of the other nodes by a query of its own: counts taken on the
        way would include the rows of tasks that Spark had to run twice. A
        node that several file sinks share is written once to the shared folder and
        removed after the run; nodes with the same meaning count as one node
        there. A failure carries the log so far.
        """
        copies, log, outputs = [], [], {}
        lazy = self.build(spark, place)
        same = self.twins(lazy) if place.base is not None else {}
        shared = self.shared(same) if place.base is not None else set()

        def keep_shared(node, df):
            if node not in shared:
                return df
            copies.append(shared_dir(spark, node) + ".parquet")
            return write_through(df, copies[-1])

        try:
            return self._write(spark, place, self.build(spark, place, after=keep_shared, made_before=lazy, same=same), count_all, log, outputs)
        finally:
            for copy in copies:
                remove(spark, copy)

    def _write(self, spark, place, frames, count_all, log, outputs):
        for node in self.outputs():
            begun = time.perf_counter()
            try:
                outputs[node] = place.write(spark, frames[node], self._key(node))
                rows = outputs[node].count()
            except Exception as error:
                made = [(n, "succeeded", None, None, None) for n in frames if n not in outputs and n != node and not self.kind[n].startswith("output")]
                raise FlowError(f"node {node!r} failed: {error}", [*made, *log, _failed(node, error, _since(begun))]) from error
            log.append((node, "succeeded", _since(begun), rows, None))
        others = [n for n in self.order if n not in outputs]
        counted = {}
        if count_all and others:
            counted = {r["node_id"]: r["rows"] for r in _counts({n: frames[n] for n in others}).collect()}
        used = set().union(*[self.ancestors(n) for n in outputs])
        for node in others:
            log.append((node, "succeeded" if node in used else "skipped", None, counted.get(node), None))
        return outputs, spark.createDataFrame(log, LOG_SCHEMA)


def _counts(frames):
    """Row count per node, as one query (node_id, rows); nodes that pass a table through are counted with it."""
    same = {}
    for node, df in frames.items():
        same.setdefault(id(df), (df, []))[1].append(node)
    counts = [df.agg(F.count("*").alias("rows")).select(F.explode(F.array(*[F.lit(n) for n in nodes])).alias("node_id"), "rows")
              for df, nodes in same.values()]
    return counts[0] if len(counts) == 1 else union_frames(*counts)


def _since(start):
    return round((time.perf_counter() - start) * 1000, 2)


def _failed(node, error, duration=0.0):
    return (node, "failed", duration, None, str(error))
