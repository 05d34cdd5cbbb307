"""Table shapes. Node ids and weights are BIGINT; an unreached level or distance is NULL and prints as INF."""

from __future__ import annotations

NODES = "node bigint"
EDGES = "src bigint, dst bigint"
WEIGHTED_EDGES = "src bigint, dst bigint, weight bigint"
VALUES = "idx bigint, value float"
INF = "INF"
