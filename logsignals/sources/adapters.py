"""Raw sources to log records, and the sinks. Files are read with declared columns; nothing is inferred."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logsignals.functions import scalar as S
from logsignals.schema import COLUMNS, LOG

# Column names of the sources.
UNSW = (
    "srcip sport dstip dsport proto state dur sbytes dbytes sttl dttl sloss dloss service sload dload spkts dpkts swin dwin stcpb dtcpb smeansz dmeansz trans_depth res_bdy_len sjit djit stime ltime "
    "sintpkt dintpkt tcprtt synack ackdat is_sm_ips_ports ct_state_ttl ct_flw_http_mthd is_ftp_login ct_ftp_cmd ct_srv_src ct_srv_dst ct_dst_ltm ct_src_ltm ct_src_dport_ltm ct_dst_sport_ltm ct_dst_src_ltm attack_cat label"
).split()
CANDIDATES = {
    "time": ("Timestamp", "Time", "Start Time"), "ip": ("Src IP", "Source IP", "SrcAddr", "Source Address"), "port": ("Destination Port", "Dst Port", "Port"),
    "duration": ("Flow Duration",), "packets": ("Total Fwd Packets",), "label": ("Label", "Attack"),
}
# End of the fixed values.


def _csv(spark: SparkSession, paths, header: bool = True, encoding: str = "UTF-8", columns: list[str] | None = None) -> DataFrame:
    reader = spark.read.option("header", header).option("encoding", encoding).option("mode", "PERMISSIVE")
    return (reader.schema(", ".join(f"`{c}` string" for c in columns)) if columns else reader).csv(paths)


def _by_file(spark: SparkSession, paths) -> DataFrame:
    """Files in UTF-8 and files in Latin-1 side by side. All are read as Latin-1, which keeps every byte; a file whose bytes are valid as UTF-8 in all rows is then decoded as that."""
    raw = _csv(spark, paths, encoding="ISO-8859-1").withColumn("_file", F.col("_metadata.file_path"))
    names = [c for c in raw.columns if c != "_file"]
    utf8 = lambda c: F.encode(c, "ISO-8859-1").cast("string")
    other = raw.groupBy("_file").agg(F.max(~F.is_valid_utf8(utf8(F.concat_ws(" ", *(F.col(f"`{c}`") for c in names))))).alias("_latin"))  # a row a file
    held = raw.join(F.broadcast(other), "_file")
    return held.select(*(F.when(F.col("_latin"), F.col(f"`{c}`")).otherwise(utf8(F.col(f"`{c}`"))).alias(_name(c)) for c in names))


def _name(header: str) -> str:
    """A header name that was read as Latin-1."""
    try:
        return header.encode("latin-1").decode()
    except UnicodeError:
        return header


def _records(df: DataFrame, **columns: Column) -> DataFrame:
    """The columns of a log record, with defaults for those not given."""
    default = {"method": F.lit("GET"), "endpoint": F.lit("/unknown"), "status": F.lit(200), "response_size": F.lit(0), "latency": F.lit(0.0), "user_agent": F.lit(""), "label": F.lit("BENIGN"), "attack_category": F.lit("Benign"), "is_attack": F.lit(False), "tenant_home_country": F.lit("")}
    all_ = default | columns
    return df.select(*(all_[f.name].cast(f.dataType).alias(f.name) for f in LOG)).filter("timestamp IS NOT NULL AND ip IS NOT NULL")


def read_logs(spark: SparkSession, paths) -> DataFrame:
    """Processed log files; rows without a valid time or address are left out. `is_attack` follows the label."""
    raw = _csv(spark, paths)
    get = lambda c, d=None: S.or_default(F.col(c), d) if c in raw.columns else F.lit(d)
    label = get("label", "BENIGN")
    return _records(
        raw, timestamp=F.try_to_timestamp("timestamp"), ip=F.nullif(F.trim("ip"), F.lit("")), method=get("method", "GET"), endpoint=get("endpoint", "/unknown"), status=F.coalesce(F.col("status").try_cast("int"), F.lit(200)),
        response_size=F.coalesce(F.col("response_size").try_cast("long"), F.lit(0)), latency=F.coalesce(F.col("latency").try_cast("double"), F.lit(0.0)), user_agent=get("user_agent", ""), label=label,
        attack_category=get("attack_category", "Benign"), is_attack=F.upper(label) != "BENIGN", tenant_home_country=get("tenant_home_country", ""),
    )


def rejected(spark: SparkSession, paths) -> DataFrame:
    """The rows that read_logs leaves out."""
    return _csv(spark, paths).filter(F.try_to_timestamp("timestamp").isNull() | (F.trim(F.coalesce("ip", F.lit(""))) == ""))


def read_unsw(spark: SparkSession, paths) -> DataFrame:
    """Files without a header, 49 columns by position."""
    raw = _csv(spark, paths, header=False, columns=UNSW)
    port = F.coalesce(F.col("dsport").try_cast("double").cast("int"), F.lit(0)).cast("string")
    category = S.unsw_category(F.col("attack_cat"))
    attack = F.coalesce(F.col("label").try_cast("double") == 1, F.lit(False)) | (category != "Benign")
    out = raw.withColumn("endpoint", F.concat(F.lit("/port_"), port))
    return _records(
        out, timestamp=F.timestamp_seconds(F.col("stime").try_cast("double")), ip=F.col("srcip"), method=S.state_method(F.col("state")), endpoint=F.col("endpoint"), response_size=F.coalesce(F.col("sbytes").try_cast("double"), F.lit(0.0)),
        latency=F.coalesce(F.least(F.col("dur").try_cast("double") * 1000, F.lit(10000.0)), F.lit(0.0)), label=F.when(attack, "ATTACK").otherwise("BENIGN"), attack_category=category, is_attack=attack,
    )


def read_flows(spark: SparkSession, paths, time_format: str = "d/M/yyyy H:m", encoding: str | None = None) -> DataFrame:
    """Flow files with names that vary; header names are trimmed and resolved by candidates. Without an encoding each file is taken as UTF-8 or, where it isn't valid in that, as Latin-1."""
    raw = _csv(spark, paths, encoding=encoding) if encoding else _by_file(spark, paths)
    raw = raw.toDF(*(c.strip() for c in raw.columns))
    at = {k: next((c for c in names if c in raw.columns), None) for k, names in CANDIDATES.items()}
    get = lambda k: F.col(at[k]) if at[k] else F.lit(None).cast("string")
    label = F.coalesce(F.trim(get("label")), F.lit("BENIGN"))
    return _records(
        raw, timestamp=F.coalesce(F.try_to_timestamp(get("time"), F.lit(time_format)), F.try_to_timestamp(get("time"))), ip=F.coalesce(F.trim(get("ip")), F.lit("0.0.0.0")), endpoint=S.port_endpoint(get("port")),
        response_size=F.coalesce(get("packets").try_cast("double"), F.lit(0.0)), latency=F.coalesce(S.latency_ms(get("duration").try_cast("double")), F.lit(0.0)), label=label, attack_category=S.category(label), is_attack=label != "BENIGN",
    )


def read_honeypot(spark: SparkSession, paths, home: str = "US") -> DataFrame:
    """Every record is an attack; rows without a dotted quad or time are left out."""
    raw = _csv(spark, paths)
    missing = {"datetime", "srcstr", "proto", "dpt"} - set(raw.columns)
    if missing:
        raise ValueError(f"columns are missing: {sorted(missing)}")
    port = F.col("dpt").try_cast("int").cast("string")
    return _records(
        raw.filter(F.trim("srcstr").rlike(r"^\d{1,3}(\.\d{1,3}){3}$")), timestamp=F.try_to_timestamp("datetime", F.lit("M/d/yy H:mm")), ip=F.trim("srcstr"), method=S.method(F.col("proto")),
        endpoint=F.concat(F.lit("/port_"), F.coalesce(port, F.lit("unknown"))), label=F.lit("GEO_ATTACK"), attack_category=F.lit("Geo Attack"), is_attack=F.lit(True), tenant_home_country=F.lit(home),
    )


def read_netflow(spark: SparkSession, paths, local: str = "147.32.") -> DataFrame:
    """Bidirectional flows; the remote address counts where the source is local."""
    raw = _csv(spark, paths)
    source, target = F.trim("SrcAddr"), F.trim("DstAddr")
    attack = F.coalesce(F.lower("Label").contains("botnet"), F.lit(False))
    endpoint = F.when(F.col("Dport").isNull() | F.col("Dport").rlike("(?i)^0x"), "/port_unknown").otherwise(F.concat(F.lit("/port_"), F.coalesce(F.col("Dport").try_cast("double").cast("int").cast("string"), F.col("Dport"))))
    return _records(
        raw, timestamp=F.try_to_timestamp("StartTime", F.lit("yyyy/MM/dd HH:mm:ss.SSSSSS")), ip=F.when(source.startswith(local), target).otherwise(source), method=S.method(F.col("Proto")), endpoint=endpoint,
        response_size=F.coalesce(F.col("TotBytes").try_cast("long"), F.lit(0)), latency=F.coalesce(F.col("Dur").try_cast("double"), F.lit(0.0)), label=F.when(attack, "BOTNET").otherwise("BENIGN"),
        attack_category=F.when(attack, "Botnet").otherwise("Benign"), is_attack=attack, tenant_home_country=F.lit("CZ"),
    )


def read_http(spark: SparkSession, paths, ip: Column | None = None, time: Column | None = None) -> DataFrame:
    """Requests with a label in the first column; the source has no address or time, so the caller names columns for both."""
    raw = _csv(spark, paths)
    normal = F.trim(F.col(f"`{raw.columns[0]}`")) == "Normal"
    size = F.coalesce(F.col("lenght").try_cast("double"), F.lit(0.0)) if "lenght" in raw.columns else F.lit(0)
    return _records(
        raw, timestamp=F.lit("1970-01-01 00:00:00").cast("timestamp") if time is None else time, ip=F.lit("0.0.0.0") if ip is None else ip, method=F.coalesce("Method", F.lit("GET")),
        endpoint=F.coalesce(S.request_path(F.col("URL"), F.trim("content")), F.lit("/")), response_size=size, latency=F.lit(0.05), user_agent=F.coalesce("User-Agent", F.lit("")),
        label=F.when(normal, "BENIGN").otherwise("Web Attack"), attack_category=F.when(normal, "Benign").otherwise("Web Attack"), is_attack=~normal,
    )


def read_known_bad(spark: SparkSession, path) -> DataFrame:
    """{"known_bad_ips": [...]} to one address a row."""
    return spark.read.schema("known_bad_ips array<string>").json(path, multiLine=True).select(F.explode("known_bad_ips").alias("ip")).dropDuplicates()


def write_logs(df: DataFrame, path: str, form: str = "parquet", parts: int = 8) -> None:
    """Sorted by time over the files."""
    df.select(*COLUMNS).repartitionByRange(parts, "timestamp").sortWithinPartitions("timestamp").write.mode("overwrite").option("header", True).format(form).save(path)


def write_verdicts(verdicts: DataFrame, metrics: DataFrame, path: str) -> None:
    """Verdicts, and the metrics beside them."""
    verdicts.write.mode("overwrite").json(f"{path}/verdicts")
    metrics.write.mode("overwrite").json(f"{path}/metrics")


def read_verdicts(spark: SparkSession, path: str, schema) -> DataFrame:
    """Verdicts to score again."""
    return spark.read.schema(schema).json(f"{path}/verdicts")
