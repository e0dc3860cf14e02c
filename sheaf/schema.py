"""Table schemas, search filters and the fixed numbers that results depend on."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import types as T

# One landed item. Declared, so that streams and repeated loads need no inference pass.
RAW_ITEM_SCHEMA = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("index", T.LongType()),
        T.StructField("network", T.StringType()),
        T.StructField("type", T.StringType()),
        T.StructField("proposalType", T.StringType()),
        T.StructField("title", T.StringType()),
        T.StructField("description", T.StringType()),
        T.StructField("content", T.StringType()),
        T.StructField("proposer", T.StringType()),
        T.StructField("amount", T.StringType()),
        T.StructField("currency", T.StringType()),
        T.StructField("status", T.StringType()),
        T.StructField("createdAt", T.StringType()),
        T.StructField(
            "onChainInfo",
            T.StructType(
                [
                    T.StructField("type", T.StringType()),
                    T.StructField("proposer", T.StringType()),
                    T.StructField("status", T.StringType()),
                ]
            ),
        ),
    ]
)

ENVELOPE_SCHEMA = T.StructType(
    [
        T.StructField("network", T.StringType()),
        T.StructField("timestamp", T.StringType()),
        T.StructField("total_items", T.LongType()),
        T.StructField("items", T.ArrayType(RAW_ITEM_SCHEMA)),
    ]
)

# Columns open to ad-hoc SQL.
PUBLIC_COLUMNS = [
    "id",
    "network",
    "type",
    "title",
    "description",
    "proposer",
    "amount_numeric",
    "currency",
    "status",
    "created_at",
    "updated_at",
]

# Fusion, cut-offs and list lengths.
RRF_K = 60
VECTOR_WEIGHT = 4.0
LEXICAL_LIMIT = 30
VECTOR_LIMIT = 50
RERANK_HEAD = 30
RERANK_CUT = 0.5
RRF_CUT = 0.045
DISPLAY_CUT = 0.015
DISPLAY_FALLBACK = 2
MAX_RESULTS = 5
TOP_K = 10
TITLE_SCORE = 0.8
DESCRIPTION_SCORE = 0.6
TRIGRAM_CUT = 0.3
SNIPPET_CHARS = 150
CLEAN_TEXT_CHARS = 1000
EMBED_DESCRIPTION_CHARS = 2000
EMBED_TEXT_CHARS = 6000
ANSWER_DESCRIPTION_CHARS = 200
EXAMPLES = 5

# Record types, networks and fetch origins.
RECORD_TYPES = [
    "DemocracyProposal",
    "TechCommitteeProposal",
    "TreasuryProposal",
    "Referendum",
    "CouncilMotion",
    "Bounty",
    "Tip",
    "ChildBounty",
    "ReferendumV2",
    "FellowshipReferendum",
]
NETWORKS = ["polkadot", "kusama"]
ORIGIN_TYPE = "ReferendumV2"
ORIGINS = [
    "AuctionAdmin",
    "BigSpender",
    "BigTipper",
    "Candidates",
    "Experts",
    "Fellows",
    "FellowshipAdmin",
    "GeneralAdmin",
    "GrandMasters",
    "LeaseAdmin",
    "Masters",
    "MediumSpender",
    "Members",
    "Proficients",
    "ReferendumCanceller",
    "ReferendumKiller",
    "Root",
    "SeniorExperts",
    "SeniorFellows",
    "SeniorMasters",
    "SmallSpender",
    "SmallTipper",
    "StakingAdmin",
    "Treasurer",
    "WhitelistedCaller",
    "WishForChange",
    "FastGeneralAdmin",
]


@dataclass(frozen=True)
class SearchFilters:
    """Optional conditions, all joined by AND. Bounds are inclusive."""

    network: str | None = None
    proposal_type: str | None = None
    status: str | None = None
    min_amount: float | None = None
    max_amount: float | None = None
    start_date: datetime | None = None
    end_date: datetime | None = None
