"""Registered queries of this package and, where SQL can say it, their oracle."""

from __future__ import annotations

from lucerna.llm import canonical, capping, encoding, languages, licenses, near_copies, packing, residue, sampling


def _t(spark, d, name):
    return spark.read.parquet(f"{d}/{name}.parquet")


def queries():
    return {
        "p1_found": lambda s, d: canonical.found(_t(s, d, "shader_records"), _t(s, d, "topic_list")),
        "p1_unmatched": lambda s, d: canonical.unmatched_report(_t(s, d, "shader_records"), _t(s, d, "topic_list")),
        "p2_found": lambda s, d: capping.found(_t(s, d, "shader_records")),
        "p2_shares": lambda s, d: capping.shares(_t(s, d, "shader_records")),
        "p3_found": lambda s, d: licenses.found(_t(s, d, "shader_records"), _t(s, d, "parent_docs"), _t(s, d, "repo_files"), _t(s, d, "license_list")),
        "p3_findings": lambda s, d: licenses.findings(_t(s, d, "shader_records"), _t(s, d, "parent_docs"), _t(s, d, "repo_files"), _t(s, d, "license_list")),
        "p4_found": lambda s, d: languages.found(_t(s, d, "shader_records"), _t(s, d, "documents")),
        "p4_shares": lambda s, d: languages.shares(_t(s, d, "shader_records"), _t(s, d, "documents")),
        "p5_found": lambda s, d: near_copies.found(_t(s, d, "shader_records")),
        "p5_membership": lambda s, d: near_copies.membership(_t(s, d, "shader_records")),
        "p6_found": lambda s, d: sampling.found(_t(s, d, "shader_records"), _t(s, d, "topic_list"), _t(s, d, "sample_targets")),
        "p6_sample": lambda s, d: sampling.draw(_t(s, d, "shader_records"), _t(s, d, "topic_list"), _t(s, d, "sample_targets"))[0],
        "p6_report": lambda s, d: sampling.draw(_t(s, d, "shader_records"), _t(s, d, "topic_list"), _t(s, d, "sample_targets"))[1],
        "p7_ids": lambda s, d: encoding.encode(_t(s, d, "documents")),
        "p7_round_trip": lambda s, d: encoding.round_trip(_t(s, d, "documents")),
        "p8_found": lambda s, d: packing.found(_t(s, d, "documents")),
        "p8_containers": lambda s, d: packing.containers(_t(s, d, "documents")),
        "p9_found": lambda s, d: residue.found(_t(s, d, "documents")),
        "p9_clean": lambda s, d: residue.clean(_t(s, d, "documents")),
        "p8_waste": lambda s, d: packing.waste(_t(s, d, "documents")),
    }


P6 = """
with n as (select count(distinct shader_id) // 10 as n from shader_records),
r as (select shader_id, max(lower(regexp_replace(source, '^[\\s\\p{Z}]+|[\\s\\p{Z}]+$', '', 'g')) || chr(1) || tags_topic[1]) as c from shader_records where shader_id is not null group by 1),
a as (select split_part(c, chr(1), 1) as source, topic_key, count(*) as have from r join topic_list on topic_name = split_part(c, chr(1), 2) group by 1, 2)
select target_id from sample_targets t left join a on a.source = lower(t.source) and a.topic_key = t.topic_key, n
where coalesce(have, 0) < greatest(coalesce(permille, 0) * n // 1000, coalesce(min_rows, 0))"""


def oracle_sql():
    return {"p6_found": P6}
