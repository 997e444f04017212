"""Chains of graphs: each stage reads the outputs of the one before."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.frames import Order
from .graph import Graph, TumbleGraph


class Pipeline:
    """Stages that hand their outputs on by position, group by group.

    A tumbling stage lets a row on only where a window ends; stages behind it see the time of the row that ended the
    window, and window_ts keeps the window's own time. Groups are never mixed, so all stages share one partitioning.
    """

    def __init__(self, groups: int | None = None):
        self.stages: list[Graph | TumbleGraph] = []
        self.parameters: list[dict] = []
        self.groups = groups

    def add_stage(self, stage: Graph | TumbleGraph, groups: int | None = None, *, parameters: DataFrame | None = None, since: str | None = None) -> Pipeline:
        """Appends a stage; its number of inputs must be the number of outputs before it, and group counts must agree. A graph's
        `parameters`, by group or by version, are those of Graph.run() for this stage alone."""
        if parameters is not None and not isinstance(stage, Graph):
            raise ValueError("only a graph has parameters")
        if not isinstance(stage, (Graph, TumbleGraph)):
            raise ValueError("a stage is a graph or a tumbling graph")
        if groups is not None and self.groups is not None and groups != self.groups:
            raise ValueError(f"the stage has {groups} groups, the pipeline {self.groups}")
        if isinstance(stage, Graph):
            stage.validate()
        if self.stages and self.stages[-1].num_outputs() != stage.num_inputs():
            raise ValueError(f"the stage reads {stage.num_inputs()} inputs, not {self.stages[-1].num_outputs()}")
        self.groups = self.groups if groups is None else groups
        self.stages.append(stage)
        self.parameters.append({} if parameters is None else {"parameters": parameters, "since": since})
        return self

    def run(self, df: DataFrame, order: Order, *, emit_partial: bool = False, late: str | None = None, time_name: str = "window_ts") -> DataFrame:
        """On a stream all stages are one stateful operator, and rows are taken in order as `late` says: see stream_scan()."""
        if not self.stages:
            raise ValueError("the pipeline has no stage")
        if df.isStreaming:
            from ..streaming.runner import stream_stages

            if any(self.parameters):
                raise ValueError("a stage of a stream has no parameters")
            return stream_stages(df, order, self.stages, late, time_name)
        names: list[str] | None = None
        for k, stage in enumerate(self.stages):
            ports = stage._ports[stage._root] if isinstance(stage, Graph) else stage.graph._ports[stage.graph._root]
            inputs = dict(zip(ports, names, strict=True)) if names is not None else None
            if isinstance(stage, Graph):
                df = stage.run(df, order, inputs=inputs, **self.parameters[k])
                names = stage.names()
            else:
                df = stage.run(df, order, inputs=inputs, emit_partial=emit_partial, arrival="__arrival")
                names = stage.names()
                df = df.withColumn(order.time, F.coalesce("__arrival", "window_ts")).drop("__arrival")
                if k < len(self.stages) - 1:
                    df = df.drop("window_ts")
                order = Order(order.groups, order.time)
            made = {n: f"__s{k}_{i}" for i, n in enumerate(names)}
            df = df.withColumnsRenamed(made)
            names = list(made.values())
        last = self.stages[-1].names()
        return df.withColumnsRenamed(dict(zip(names, last, strict=True)))
