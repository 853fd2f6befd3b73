"""Log lines made from the events table, by the same expressions in Spark SQL and in other SQL engines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

IP = "concat('10.', cast(user_id % 200 as string), '.', cast(event_id % 250 as string), '.', cast(event_id % 13 as string))"
_BODY = f"""case event_type
  when 'error' then concat('sshd(pam_unix)[', cast(1000 + event_id % 900 as string), ']: authentication failure; logname= uid=0 euid=0 tty=NODEVssh ruser= rhost=', case when event_id % 3 = 0 then {IP} else concat('h', cast(user_id % 40 as string), '.example.net') end, case when event_id % 4 = 0 then '' else concat('  user=u', cast(user_id as string)) end)
  when 'signup' then concat('su(pam_unix)[', cast(1000 + event_id % 900 as string), ']: session opened for user u', cast(user_id as string), ' by (uid=0)')
  when 'purchase' then concat('su(pam_unix)[', cast(1000 + event_id % 900 as string), ']: session closed for user u', cast(user_id as string))
  when 'click' then concat('ftpd[', cast(1000 + event_id % 900 as string), ']: connection from ', {IP}, ' (', case when event_id % 2 = 0 then concat('h', cast(user_id % 40 as string), '.example.net') else '' end, ') at noon')
  else case event_id % 6
    when 0 then 'cups: cupsd startup succeeded' when 1 then 'syslogd 1.4.1: restart.' when 2 then 'logrotate: ALERT exited abnormally with [1]'
    when 3 then concat('snmpd[', cast(1000 + event_id % 900 as string), ']: Received SNMP packet(s) from ', {IP}) when 4 then concat('sudo: u', cast(user_id as string), ' : TTY=pts/0 ; USER=root ; COMMAND=/bin/tool', cast(user_id % 9 as string)) else '' end end"""
_HOST = "concat('host', cast(user_id % 7 as string))"
#: {stamp} is the engine's rendering of ts as in "Jan 02 03:04:05"
LINE = f"case when event_type = 'view' and event_id % 6 = 5 then case when event_id % 12 = 5 then '' else 'no layout here' end else concat({{stamp}}, ' ', {_HOST}, ' ', {_BODY}) end"
SPARK_STAMP, DUCK_STAMP = "date_format(ts, 'MMM dd HH:mm:ss')", "strftime(ts, '%b %d %H:%M:%S')"

#: the same events in five layouts, in turns of 500 lines, the last of which nothing fits
MIXED = f"""case cast(floor(event_id / 500) as bigint) % 5
  when 0 then concat({{stamp}}, ' ', {_HOST}, ' app[', cast(event_id % 900 as string), ']: step ', cast(event_id as string), ' done')
  when 1 then concat({{iso}}, ' ', {_HOST}, ' app[', cast(event_id % 900 as string), ']: step ', cast(event_id as string), ' done')
  when 2 then concat('{{{{"level": "warn", "service": "app", "msg": "step ', cast(event_id as string), ' done"}}}}')
  when 3 then concat({{short}}, ' ', cast(event_id % 900 as string), ' INFO app.Step: step ', cast(event_id as string), ' done')
  else case when event_id % 10 = 0 then concat('    at frame ', cast(event_id as string)) else concat('words only ', cast(event_id as string)) end end"""
_SPARK_MIX = {"stamp": SPARK_STAMP, "iso": "date_format(ts, \"yyyy-MM-dd'T'HH:mm:ss\")", "short": "date_format(ts, 'yyMMdd HHmmss')"}


def _table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """``df`` on all cores; one that already has a partition for each is left alone."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def syslog_lines(spark: SparkSession, d: str) -> DataFrame:
    return spread(_table(spark, d, "events")).selectExpr("'events' as file_path", "event_id + 1 as line_number", f"{LINE.format(stamp=SPARK_STAMP)} as line")


def mixed_lines(spark: SparkSession, d: str) -> DataFrame:
    return spread(_table(spark, d, "events")).selectExpr("'mixed' as file_path", "event_id + 1 as line_number", f"{MIXED.format(**_SPARK_MIX)} as line")


DUCK_LINES = f"lines as (select 'events' as file_path, event_id + 1 as line_number, {LINE.format(stamp=DUCK_STAMP)} as line from events)"
