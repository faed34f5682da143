"""Rules and summaries over heartbeat snapshots and probe results."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventlane.functions.text import hour_minute

ALERT = "struct<severity:string,event:string,message:string,healed:boolean>"
EPOCH = "yyyy-MM-dd'T'HH:mm:ss'Z'"


@dataclass(frozen=True)
class HealthConfig:
    """Names and addresses of a deployment; ``broker_service`` holds ``{id}``."""

    relay_service: str
    broker_service: str
    relay_ip: str
    required_services: tuple[str, ...]
    relay_port: int = 8080
    broker_port: int = 9092
    health_url: str = ""
    health_expect: str = "ok"
    health_restart_service: str = ""


def _alert(severity: str, event: Column, message: Column, healed: bool = True) -> Column:
    return F.struct(
        F.lit(severity).alias("severity"), event.alias("event"), message.alias("message"), F.lit(healed).alias("healed")
    )


def _text(*parts) -> Column:
    return F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))


def _stuck(vm: Column, state: Column, service: Column, pid: Column) -> Column:
    alive = F.coalesce(pid, F.lit("")) != ""
    return F.when(
        alive & F.regexp_like(state, F.lit("D|Z")),
        _alert(
            "critical",
            _text("firecracker_", vm, "_stuck"),
            _text("firecracker ", vm, " process state=", state, "; restarting ", service),
        ),
    )


def health_rules(heartbeats: DataFrame, config: HealthConfig) -> DataFrame:
    """One row per alert a heartbeat gives rise to, in rule order.

    Brokers are checked through a higher-order function, so a heartbeat is
    exploded once, into its alerts only.
    """
    prefix, suffix = config.broker_service.split("{id}")

    def broker_alerts(b: Column) -> Column:
        down = F.when(
            F.coalesce(b["port_9092"], F.lit("")) != "open",
            _alert(
                "critical",
                _text("kafka_port_down_", b["id"]),
                _text("broker ", b["id"], " at ", b["ip"], f":{config.broker_port} is down"),
            ),
        )
        stuck = _stuck(b["id"], b["firecracker_state"], _text(prefix, b["id"], suffix), b["firecracker_pid"])
        return F.array(stuck, down)

    brokers = F.flatten(F.transform(F.coalesce(F.col("vms.kafka_brokers"), F.array()), broker_alerts))
    relay = F.col("vms.relay")
    rules = [
        _stuck(F.lit("relay"), relay["firecracker_state"], F.lit(config.relay_service), relay["firecracker_pid"]),
        F.when(
            F.coalesce(relay["port_8080"], F.lit("")) != "open",
            _alert(
                "critical",
                F.lit("relay_port_down"),
                F.lit(f"relay port {config.relay_ip}:{config.relay_port} is down"),
            ),
        ),
    ]
    if config.health_url:
        body = F.coalesce(F.col("health_endpoint"), F.lit(""))
        healthy = (body != "") & F.contains(body, F.lit(config.health_expect))
        rules.append(
            F.when(
                ~healthy,
                _alert(
                    "warning",
                    F.lit("relay_health_failed"),
                    F.lit(f"relay health check failed at {config.health_url}"),
                    bool(config.health_restart_service),
                ),
            )
        )
    for name in config.required_services:
        service = name.strip()
        if not service:
            continue
        state = F.coalesce(F.element_at("services", F.lit(service)), F.lit("unknown"))
        rules.append(
            F.when(
                state != "active",
                _alert(
                    "warning",
                    F.lit(f"required_service_down_{service}"),
                    _text(f"required service {service} is ", state),
                ),
            )
        )
    alerts = F.array_compact(F.concat(brokers, F.array(*rules)))
    return heartbeats.select("host", "timestamp", F.posexplode(alerts).alias("rule", "alert")).select(
        "host", "timestamp", "rule", "alert.*"
    )


def probe_mismatch(probes: DataFrame, expected: str = "expected", observed: str = "observed") -> DataFrame:
    """Probes whose HTTP code is not the expected one; no reply counts as ``000``."""
    seen = F.coalesce(F.col(observed).cast("string"), F.lit("000"))
    return probes.withColumn(observed, seen).filter(F.col(expected).cast("string") != seen)


def latest_status(heartbeats: DataFrame) -> DataFrame:
    """Latest heartbeat per host with memory in MB and a broker summary.

    Of heartbeats of one time the largest counts, by ``seq`` where there is one.
    """
    ties = [c for c in ("seq",) if c in heartbeats.columns] or ["uptime_seconds", "load"]
    last = heartbeats.groupBy("host").agg(
        F.max_by(F.struct(*[c for c in heartbeats.columns if c != "host"]), F.struct("timestamp", *ties)).alias("h")
    )
    relay = F.col("h.vms.relay")
    brokers = F.array_join(
        F.transform(
            F.col("h.vms.kafka_brokers"), lambda b: _text(b["id"], "=", b["ping"], ":", b["port_9092"], ":", b["service"])
        ),
        ", ",
    )
    return last.select(
        "host",
        F.col("h.timestamp").alias("last_heartbeat"),
        F.floor("h.uptime_seconds").alias("uptime_seconds"),
        F.floor(F.col("h.memory.available_kb") / 1024).alias("available_mb"),
        F.floor(F.col("h.memory.total_kb") / 1024).alias("total_mb"),
        F.col("h.load").alias("load"),
        _text(relay["ping"], ":", relay["port_8080"], ":", relay["service"]).alias("relay"),
        F.when(F.size("h.vms.kafka_brokers") > 0, brokers).alias("brokers"),
        F.col("h.external_connectivity").alias("external"),
    )


def heartbeat_gaps(heartbeats: DataFrame, epoch: Column | None = None, slice_seconds: int = 86_400) -> DataFrame:
    """Seconds since the host's previous heartbeat, also split in hours and minutes.

    Hosts are cut into time slices, so that a busy host is spread over many
    tasks: gaps inside a slice come from a window over (host, slice), gaps
    across slices from the slices' first and last times.
    """
    at = F.unix_timestamp("timestamp", EPOCH) if epoch is None else epoch
    beats = heartbeats.select("host", at.alias("epoch")).withColumn(
        "slice", F.call_function("div", F.col("epoch"), F.lit(slice_seconds))
    )
    inside = Window.partitionBy("host", "slice").orderBy("epoch")
    within = beats.select("host", "epoch", (F.col("epoch") - F.lag("epoch").over(inside)).alias("gap_seconds"))
    edges = beats.groupBy("host", "slice").agg(F.min("epoch").alias("epoch"), F.max("epoch").alias("last"))
    across = Window.partitionBy("host").orderBy("slice")
    between = edges.select("host", "epoch", (F.col("epoch") - F.lag("last").over(across)).alias("gap_seconds"))
    gaps = within.unionByName(between).filter(F.col("gap_seconds").isNotNull())
    return gaps.withColumn("gap_text", hour_minute("gap_seconds"))


def recovered_count(alerts: DataFrame, keys: Sequence[str] = ("host", "timestamp")) -> DataFrame:
    """Healed checks per run; runs without any are left out."""
    return (
        alerts.groupBy(*keys)
        .agg(F.count_if("healed").alias("recovered"))
        .filter(F.col("recovered") > 0)
        .withColumn("message", F.concat(F.lit("watchdog recovered "), F.col("recovered").cast("string"), F.lit(" services")))
    )
