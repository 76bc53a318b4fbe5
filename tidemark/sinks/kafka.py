"""Publishing a restore to Kafka, where the connector is installed."""
from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame

from tidemark.plans.publish import SINK_COLUMNS

FORMAT = "kafka"


def write_options(bootstrap_servers: str | Iterable[str], **extra: str) -> dict[str, str]:
    servers = bootstrap_servers if isinstance(bootstrap_servers, str) else ",".join(bootstrap_servers)
    # one in-flight request per connection keeps retries from reordering a partition
    opts = {"kafka.bootstrap.servers": servers, "kafka.max.in.flight.requests.per.connection": "1",
            "kafka.enable.idempotence": "true", "kafka.acks": "all"}
    opts.update(extra)
    return opts


def write_kafka(frame: DataFrame, bootstrap_servers, **extra: str) -> None:
    """Send a ``publish_frame`` to its topics and partitions; a failed send fails the job.

    Run the commit plan only after this returns, and check the target's
    partition sizes first: a retried task can send a message twice."""
    frame.select(*SINK_COLUMNS).write.format(FORMAT).options(**write_options(bootstrap_servers, **extra)).save()
