"""Schemas of the data model, and the trace's codes and costs."""

from __future__ import annotations

VERTICES = "v long, x double, y double"
EDGES = "e long, src long, dst long, w double"
PATHS = "v long, dist double, pred long"
LABEL = "struct<length:double,n_edges:long,curr:long,pred:long>"
TRACE = "run_id string, lane int, idx long, chunk int, row int, kind int, vertex int, edge int, aux0 int, aux1 int, aux2 int, aux_f double, cost long"

#: Codes of the trace's eight kinds.
KINDS = ("relax", "settle", "heap", "pivot", "batch", "recurse", "forest", "dstruct")
RELAX, SETTLE, HEAP, PIVOT, BATCH, RECURSE, FOREST, DSTRUCT = range(8)
#: Codes of the kinds' operations.
HEAP_OPS = ("push", "popmin", "sift")
PHASES = ("start", "end")
DIRECTIONS = ("in", "out")
FOREST_OPS = ("grow", "cut")
DSTRUCT_OPS = ("insert", "batchPrepend", "pull", "merge")
#: Fixed value: rows of one slab of a trace.
SLAB = 65_536
#: Fixed value: billed operations between two keyframes.
KEYFRAME_WORK = 250_000
#: Fixed value: missing vertex, edge or operand in a trace row.
NONE = -1
