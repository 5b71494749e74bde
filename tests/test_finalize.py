"""One commit over all tables of a batch: broken off anywhere, none of it is seen."""

import json

import pytest

from linkloom.operators import projection as P
from linkloom.sources.finalize import DocumentStore
from linkloom.streaming.maintenance import GraphStore


def scan(spark, *runs):
    body = lambda host, tag: {"input": host, "type": "domain", "timestamp": "2024-01-01", "dns": {"A": ["8.8.8.8"]}, "page_metadata": {"favicon_md5": tag}, "whois": {"name": [tag], "nameservers": ["NS1.X.test."]}, "spf_origins": [{"ip": "9.9.9.9"}]}
    return spark.createDataFrame([(run, json.dumps(body(host, tag))) for run, host, tag in runs], "run string, json string").coalesce(1)


class Broken(DocumentStore):
    """Fails when it is about to write a table."""

    fails = None

    def _write(self, rows, table, number):
        if table == self.fails:
            raise OSError(table)
        super()._write(rows, table, number)


def test_killed_and_delivered_again(spark, tmp_path):
    store = Broken(spark, str(tmp_path / "docs"), GraphStore(spark, str(tmp_path / "graph")))
    with pytest.raises(ValueError):
        store.read("favicons")
    store.save(scan(spark, ("r1", "a.test", "m1"), ("r2", "b.test", "m1")), 0)
    favicons = lambda: sorted(map(tuple, store.read("favicons").select("run", "md5").collect()))
    assert favicons() == [("r1", "m1"), ("r2", "m1")]
    second = scan(spark, ("r2", "b.test", "m2"), ("r3", "c.test", "m3"))
    for table in ("historical_dns", "manifests"):  # among the tables, and after all
        store.fails = table
        with pytest.raises(OSError):
            store.save(second, 1)
        assert store.committed() == [0] and favicons() == [("r1", "m1"), ("r2", "m1")]
        assert store.graph.versions("dirty") == [0]
    store.fails = None
    apply, store.graph.apply = store.graph.apply, None
    with pytest.raises(TypeError):  # the graph fails after the commit
        store.save(second, 1)
    assert store.committed() == [0, 1] and favicons() == [("r1", "m1"), ("r2", "m2"), ("r3", "m3")]
    store.graph.apply = apply
    store.save(second, 1)
    store.save(scan(spark, ("r9", "z.test", "m9")), 1)  # done: changes nothing
    assert store.graph.versions("dirty") == [0, 1] and favicons() == [("r1", "m1"), ("r2", "m2"), ("r3", "m3")]
    names = {r.table for r in spark.read.parquet(store._at("manifests", 1)).collect()}
    assert len(names) == 20 and all({r.run for r in store.read(t).select("run").collect()} == {"r1", "r2", "r3"} for t in ("documents", "dns_records", "nameservers", "page_metadata", "discovered_targets"))
    got = {(r.entity, r.kind) for r in store.graph.observations().where("kind = 'favicon_md5' OR kind = 'shared_ip'").collect()}
    assert got == {(h, k) for h in ("a.test", "b.test", "c.test") for k in ("favicon_md5", "shared_ip")}


def test_tables_of_odd_documents(spark):
    """Errors, other shapes and empty parts give no rows."""
    rows = [json.dumps({"input": "a.test", "whois": {"error": "x", "name": ["N"], "nameservers": ["ns.x.test"]}, "origin_candidates": {"scan": {"skipped": "yes", "hits": [{"ip": "1.2.3.4"}]}, "censys": {"hits": [{"ip": None}, {"ip": "1.2.3.5", "asn": "7"}]}}, "historical_dns": {"records": []}, "page_metadata": {"favicon_md5": ""}}), "[]", None]
    t = P.child_tables(P.parsed(spark.createDataFrame([(str(i), r) for i, r in enumerate(rows)], "run string, json string")))
    empty = ("scan_hits", "historical_dns", "spf_origins", "registrant_emails", "registrant_names", "nameservers", "favicons")
    assert len(t) == 19 and [n for n in empty if t[n].count()] == []
    assert [(r.provider, r.ip, r.asn) for r in t["provider_hits"].collect()] == [("censys", "1.2.3.5", "7")]
