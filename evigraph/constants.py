"""Fixed values of the data model: vocabularies, ranking constants and limits."""

# Identifier prefixes and closed vocabularies of the file and table formats.
ID_PREFIXES = ("ws", "src", "rev", "kn", "clm", "rel", "evd", "syn", "prp", "pri", "run", "chk")
LIFECYCLE = ("active", "superseded", "retracted")
EVIDENCE_STATUS = ("supported", "uncertain", "conflicting", "unreviewed")
STANCE = ("supports", "contradicts", "context")
EXTRACTION_METHOD = ("parser", "model", "human")
STORAGE_MODE = ("managed", "referenced", "snapshot-url")
RECORD_TYPES = ("node", "claim", "source", "synthesis", "chunk")
MENTION_KIND = ("source", "wiki_link")
CONFLICT_STATUS = ("open", "resolved", "dismissed")
SYNTHESIS_STATUS = ("draft", "reviewed", "archived")
PROPOSAL_STATE = ("draft", "reviewing", "approved", "applied", "rejected", "stale")
DECISION = ("pending", "accepted", "rejected")
RISK = ("low", "medium", "high")
RUN_STATUS = ("queued", "running", "paused", "interrupted", "succeeded", "failed", "cancelled", "partial")
RESEARCH_TYPES = ("Paper", "Concept", "Method", "Model", "Dataset", "Benchmark", "Finding", "Hypothesis", "Experiment", "Gene", "CellType")
RESEARCH_PREDICATES = ("proposes", "uses", "extends", "compared_with", "evaluated_on", "supports", "contradicts", "predicts", "targets", "affects", "derived_from", "cites")
SELF_LOOP_PREDICATES = ("related_to", "same_as")

# Rank fusion and boosts.
RRF_K = 60
CHANNEL_WEIGHTS = {"word": 1.0, "trigram": 0.8, "vector": 1.0}
BOOST_NAME, BOOST_ALIAS, BOOST_PREFIX, BOOST_CAP = 0.05, 0.04, 0.02, 0.08
CANDIDATES, MAX_CANDIDATES = 100, 500

# Limits of graph and list operations.
NEIGHBOR_DEPTH, MAX_NEIGHBOR_DEPTH = 1, 3
PATH_DEPTH, MAX_PATH_DEPTH, PATHS, MAX_PATHS = 4, 6, 3, 10
MAX_NODES, MAX_EDGES = 500, 1000
PAGE, MAX_PAGE = 20, 100
MAX_QUOTE, MAX_SNIPPET = 1000, 400
CHUNK_TARGET, CHUNK_MAX, CHUNK_OVERLAP = 700, 1000, 100
RETRY_STATUS, MAX_RETRIES = (408, 429), 2

# Own choices where the model leaves a value open.
BM25_K1, BM25_B, BM25_FLOOR = 1.2, 0.75, 1e-6
DUPLICATE_SIMILARITY, RESOLUTION_MARGIN = 0.92, 0.05
REPAIR_WINDOW = 200
MAX_BUNDLE = 500
EVIDENCE_ORDER = {"supported": 0, "uncertain": 1, "conflicting": 2, "unreviewed": 3}
