"""Registered queries with their SQL."""

from driftcast.plans import codings, colours, layers, packets, pictures, reports, sessions, storage, telemetry  # noqa: F401
from driftcast.plans.registry import COVERS, QUERIES, SQL  # noqa: F401
