"""Derived input views over the driver tables, each as Spark SQL and as DuckDB SQL.

The two dialects differ only in the marked spots, so one text serves both: ``{day}`` and ``{micros}`` of events.ts, and how a
text is cut into ``{utterances}``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

SPARK = {
    "day": "cast(dayofmonth(ts) as int)",
    "micros": "(unix_micros(cast(ts as timestamp)) - unix_micros(cast(date_trunc('day', ts) as timestamp)))",
    "epoch": "unix_micros(cast(ts as timestamp))",
    "utterances": "(select doc_id, source, posexplode(regexp_extract_all(regexp_replace(text, '[^\\\\x20-\\\\x7E]', '~'), '.{{1,60}}', 0)) as (pos, ref) from documents)",
    "originals": "(select doc_id, source, posexplode(regexp_extract_all(text, '[^\\n]{{1,60}}', 0)) as (pos, ref) from documents)",
    "nl": "chr(10)",
}
DUCK = {
    "day": "cast(day(ts) as int)",
    "micros": "(epoch_us(ts) - epoch_us(date_trunc('day', ts)))",
    "epoch": "epoch_us(ts)",
    "utterances": "(select doc_id, source, unnest(range(len(c))) as pos, unnest(c) as ref from (select doc_id, source, regexp_extract_all(regexp_replace(text, '[^\\x20-\\x7E]', '~', 'g'), '.{1,60}') as c from documents))",
    "originals": "(select doc_id, source, unnest(range(len(c))) as pos, unnest(c) as ref from (select doc_id, source, regexp_extract_all(text, '[^\\n]{1,60}') as c from documents))",
    "nl": "chr(10)",
}

VIEWS = {
    # speaker tracks
    "v_seg": """select {day} as recording_id, cast(user_id % 4 as int) as speaker, event_id as seg_id, event_type as kind,
  {micros} / 1e6 as start_s, {micros} / 1e6 + value as end_s from events""",
    # timed utterances
    "v_utt": """select conv_id as recording_id, role as speaker, turn, text,
  case when turn % 5 = 4 then null when role = 'system' then -1 else cast(floor(turn / 2) % 2 as int) end as spk,
  floor((sum(length(text) / 40.0e0) over w - length(text) / 40.0e0 + 0.05e0 * turn - 0.6e0 * floor(turn / 3)) * 1e6 + 0.5e0) / 1e6 as start_s,
  floor((sum(length(text) / 40.0e0) over w + 0.05e0 * turn - 0.6e0 * floor(turn / 3)) * 1e6 + 0.5e0) / 1e6 as end_s
  from conversations window w as (partition by conv_id order by turn rows unbounded preceding)""",
    # reference and hypothesis: all texts, cut into utterances of 60 characters; what isn't printable ASCII counts as ~, as the two
    # engines measure edit distances of other characters differently
    "v_pair": """select doc_id * 1000000 + pos as utt_id, doc_id, pos, source, ref, replace(replace(ref, 'the', 'te'), 'an', 'on') as hyp from {utterances} u""",
    # the same of texts as they are, in any script; the hypothesis loses accents and letters
    "v_orig": """select doc_id * 1000000 + pos as utt_id, doc_id, pos, source, ref, replace(replace(replace(ref, 'é', 'e'), 'ó', 'ö'), 'en', 'ü') as hyp from {originals} u""",
    # two-speaker pairs: neighbouring utterances of a text
    "v_pair2": """select utt_id, source, r1, r2, case when pos % 2 = 1 then n2 else n1 end as h1, case when pos % 2 = 1 then n1 else n2 end as h2
  from (select utt_id, pos, source, ref as r1, lead(ref) over (partition by doc_id order by pos) as r2, hyp as n1, lead(hyp) over (partition by doc_id order by pos) as n2 from v_pair) t where r2 is not null""",
    # consensus candidates, with shuffled order, an empty one and ties
    "v_cand": """select utt_id as group_id, cast((variant + pos) % 4 as int) as ord, case when variant = 0 then ref when variant = 1 then case when pos % 3 = 0 then '' else hyp end
  when variant = 2 then substr(ref, 1, greatest(0, length(ref) - 4)) else replace(ref, 'e', '') end as text from v_pair, (values (0), (1), (2), (3)) as t(variant)""",
    # timed transcript lines
    "v_lines": """select recording_id, turn, case when turn % 7 = 6 then replace(text, {nl}, ' ') else
  concat('[', lpad(cast(cast(floor(greatest(start_s, 0e0) / 3600) as int) as varchar(9)), 2, '0'), ':', lpad(cast(cast(floor(greatest(start_s, 0e0) / 60) as int) % 60 as varchar(9)), 2, '0'), ':',
  lpad(cast(cast(floor(greatest(start_s, 0e0)) as int) % 60 as varchar(9)), 2, '0'), ' --> ', lpad(cast(cast(floor(end_s / 3600) as int) as varchar(9)), 2, '0'), ':',
  lpad(cast(cast(floor(end_s / 60) as int) % 60 as varchar(9)), 2, '0'), ':', lpad(cast(cast(floor(end_s) as int) % 60 as varchar(9)), 2, '0'), '] ',
  case when turn % 11 = 10 then '' else concat(speaker, ': ') end, replace(text, {nl}, ' ')) end as line from v_utt""",
    # job status events
    "v_status": """select event_id, user_id as job_id, case cast(event_id % 9 as int) when 0 then 'queued' when 1 then 'preparing' when 2 then 'decoding' when 3 then 'denoising'
  when 4 then 'vad' when 5 then 'overlap' when 6 then 'recognizing' when 7 then 'separating' else 'finalizing' end as phase, value, value * 1000 as elapsed_ms,
  case cast(event_id % 10 as int) when 0 then 'Operation cancelled' when 1 then 'ENOSPC: no space left' when 2 then 'EACCES: permission denied' when 3 then 'out of memory'
  when 4 then 'worker process exited' when 5 then 'ffmpeg: invalid data' when 6 then 'model weights not found' when 7 then 'broken pipe' when 8 then 'something else' else '' end as message
  from events""",
    # stem-gate inputs
    "v_gate": """select event_id, value / 500 as share, (event_id % 101) / 100.0e0 as corr, (user_id % 50) / 100.0e0 as emb_dist, user_id % 7 = 0 as no_text, user_id % 11 = 0 as no_anchor
  from events""",
    # evaluated cases
    "v_cases": """select utt_id as case_id, source as dataset, cast((utt_id % 3 - 1) * 6 as int) as snr_db, ((utt_id % 4) + 1) / 4.0e0 as overlap_ratio, length(r1) + length(r2) as reference_chars,
  cast(utt_id % 40 as int) as mixture_distance, cast(utt_id % 29 as int) as separated_distance, utt_id % 5 < 3 as gate_accepted, 1 + (utt_id % 17) / 4.0e0 as duration_s,
  cast(100 + utt_id % 900 as int) as separation_ms from v_pair2""",
}
NEEDS = {
    "v_seg": ["events"], "v_utt": ["conversations"], "v_pair": ["documents"], "v_orig": ["documents"], "v_pair2": ["v_pair"], "v_cand": ["v_pair"], "v_lines": ["v_utt"],
    "v_status": ["events"], "v_gate": ["events"], "v_cases": ["v_pair2"],
}


SMALL = 32 << 20  # bytes for each core, up to which a table of few files is dealt over all cores


def _spread(table: DataFrame) -> DataFrame:
    """Texts of few and small files over all cores: a file's row group is one task, and every text becomes many utterances in it.
    Larger tables are read as they lie, without a shuffle."""
    cores = table.sparkSession.sparkContext.defaultParallelism
    size = int(str(table._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return table.repartition(cores) if len(table.inputFiles()) < cores and size <= SMALL * cores else table


def spark_view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view, or a table of the data directory, as a DataFrame."""
    if name not in VIEWS:
        table = spark.read.parquet(f"{sf_dir}/{name}.parquet")
        return _spread(table) if name == "documents" else table
    text = VIEWS[name].format(**SPARK)
    return spark.sql(text.replace(f"from {NEEDS[name][0]}", "from {source}"), source=spark_view(spark, sf_dir, NEEDS[name][0]))


def duck_with(*names: str) -> str:
    """``WITH`` clauses (without the keyword) that define the views and what they need."""
    done: list[str] = []

    def add(n: str) -> None:
        for need in NEEDS[n]:
            if need in VIEWS:
                add(need)
        if n not in done:
            done.append(n)

    for n in names:
        add(n)
    return ",\n".join(f"{n} as ({VIEWS[n].format(**DUCK)})" for n in done)
