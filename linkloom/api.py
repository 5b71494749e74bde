"""The engine's reads as functions of a set of graph tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .constants import SELECTOR_WEIGHTS, TRACKING_WEIGHTS, Config
from .functions.scoring import CONFIG
from .operators import components as C
from .operators import graph_build as G
from .operators import links as L
from .operators import reads as R
from .operators.suffixes import reentered
from .storage import small, written


@dataclass
class Engine:
    """Tables of a graph, and what is computed from them once.

    observations: entity, kind, value, source, first_seen, last_seen;
    edges: src, dst, kind, source, first_seen, last_seen;
    entities: kind, value, rd, first_seen, last_seen; tiers: rd, tier;
    certificate_names: sha256, san."""

    observations: DataFrame
    edges: DataFrame
    entities: DataFrame
    tiers: DataFrame
    as_of: str
    certificate_names: DataFrame | None = None
    address_context: DataFrame | None = None  # value, cloudflare, proxy_family, in_net, texts, flags, labels
    weights: dict[str, float] | None = None
    cfg: Config = CONFIG
    suffix_rules: DataFrame | None = None  # suffix, rule, private: entities get their domains by them

    def __post_init__(self) -> None:
        if self.suffix_rules is not None:
            self.entities = written(reentered(self.entities, self.suffix_rules), "entities")
        self.recompute()

    def recompute(self) -> None:
        """Full rebuild of selectors, links and clusters."""
        first = G.selectors(self.observations, self.certificate_names, self.cfg)
        noisy = written(L.noisy_addresses(self.observations, first, self.address_context), "noisy")
        rows = L.with_addresses(self.observations, self.edges)
        self.selectors = written(G.selectors(rows, self.certificate_names, self.cfg, owners=self.entities.select("value", "rd"), noisy=noisy), "selectors")
        self.all_links = written(L.links(rows, self.entities, self.selectors, self.as_of, self.weights, cfg=self.cfg), "links")
        owners = self.entities.where("rd IS NOT NULL").select(F.col("value").alias("entity"), "rd")
        good = self.selectors.where("attributing AND kind <> 'shared_ip'").select("kind", "value")
        self.members = written(self.observations.join(good, ["kind", "value"], "left_semi").join(owners, "entity").select("rd", "kind", "value").distinct(), "members")
        self.labels, self.connectors = C.clusters(self.members, ["kind", "value"], self.cfg.cluster_fanout)

    def pool(self, **filters) -> DataFrame:
        counts = self.all_links.groupBy(F.col("a").alias("rd")).agg(F.count(F.lit(1)).alias("connections"))
        return R.pool(self.entities, counts, self.labels, self.tiers, **filters)

    def domain(self, name: str) -> DataFrame:
        """Hosts of a domain with their windows and numbers of selectors."""
        hosts = self.entities.where(F.col("rd") == name).select("kind", F.col("value").alias("entity"), "first_seen", "last_seen")
        n = self.observations.groupBy("entity").agg(F.countDistinct("kind", "value").alias("selectors"))
        return hosts.join(n, "entity", "left").fillna(0, ["selectors"])

    def links(self, name: str, limit: int = 50, min_score: float = 1.0) -> DataFrame:
        return L.ranked(self.all_links.where(F.col("a") == name), limit, min_score)

    connections = links

    def link(self, a: str, b: str) -> DataFrame:
        """The link of two domains; a domain has none with itself."""
        return self.all_links.where((F.col("a") == a) & (F.col("b") == b) & F.lit(a != b))

    def selector_kinds(self) -> DataFrame:
        return self.members.groupBy("kind", "value").count().where("count >= 2").groupBy("kind").agg(F.count(F.lit(1)).alias("groups")).orderBy(F.desc("groups"), "kind")

    def by_selector(self, kind: str, limit: int = 200, min_domains: int = 2) -> DataFrame:
        """The values of a kind that most domains share, one row per domain:
        value, degree, rd. Domains are listed for the values shown alone."""
        mine = self.members.where(F.col("kind") == kind).select("value", "rd")
        shown = mine.groupBy("value").agg(F.count("rd").alias("degree")).where(F.col("degree") >= min_domains).orderBy(F.desc("degree"), "value").limit(limit)
        return mine.join(shown, "value").select("value", "degree", "rd").orderBy(F.desc("degree"), "value", "rd")

    def path(self, a: str, b: str) -> DataFrame:
        return C.path_between(C.paths(self.all_links.select("a", "b", "score"), F.col("a").isin(a, b), self.cfg), a, b)

    def related(self, name: str, limit: int = 50) -> DataFrame:
        found = C.paths(self.all_links.select("a", "b", "score"), F.col("a") == name, self.cfg)
        return found.orderBy("hops", F.desc("min_hop_score"), "target").limit(limit)

    def search(self, needle: str, limit: int = 20) -> DataFrame:
        counts = self.all_links.groupBy(F.col("a").alias("value")).agg(F.count(F.lit(1)).alias("weight"))
        domains = self.entities.where("rd IS NOT NULL").select(F.col("rd").alias("value")).distinct().join(counts, "value", "left").fillna(0, ["weight"]).withColumn("what", F.lit("domain"))
        return R.search(domains.unionByName(self.selectors.where("kind <> 'shared_ip'").select("value", F.col("degree").alias("weight"), F.col("kind").alias("what"))), needle, limit)

    def clusters(self, min_size: int = 2, limit: int = 100) -> DataFrame:
        return self.labels.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") >= min_size).orderBy(F.desc("size"), "cluster_id").limit(limit)

    def cluster(self, name: str) -> DataFrame:
        """Members of a domain's cluster."""
        mine = self.labels.where(F.col("rd") == name).select("cluster_id")
        return self.labels.join(small(mine), "cluster_id", "left_semi")

    @staticmethod
    def evidence_catalog() -> list[dict]:
        """Kinds of evidence, heaviest first, with a label."""
        kinds = SELECTOR_WEIGHTS | {f"tracking_id|{k}": v for k, v in TRACKING_WEIGHTS.items()}
        return [{"kind": k, "weight": w, "label": k.replace("|", ": ").replace("_", " ")} for k, w in sorted(kinds.items(), key=lambda x: (-x[1], x[0]))]
