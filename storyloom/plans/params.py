"""Parameters of the registered queries (shared by the Spark plans and the SQL oracle)."""

# Defaults of the behaviour being matched.
STORY_K = 50          # articles retrieved per storyline topic
DOC_SEARCH_K = 5      # hits per documentation query
EVAL_K = 20           # articles retrieved per evaluation topic
MAX_ATTEMPTS = 2      # generation attempts before the final clean-up
CONTEXT_CHARS = 1200  # characters of each source shown to the generator
CHUNK_MAX_CHARS = 2000
MIN_RATING = 0.0

# Our choices for the registered queries.
DENSE_K = 10              # neighbours per dense query
SEARCH_STEP = 20          # every row whose id is divisible by it is a query of the self search
LOOP_K = 5                # sources per topic of the live generation loop
LOOP_IDS = 7              # article ids of that loop repeat: doc_id modulo this
THRESHOLD = 0.35         # least similarity of the text search with a threshold
RECALL = 0.9              # share of exact hits that the trained index must find
TRIAL_STEP = 20           # its probes are chosen on rows whose id leaves 7 modulo this
TRIAL_RECALL = 0.95       # share that they must find of those rows' hits
ACCOUNTING_MIN_RATING = 5.0
AS_OF = "2024-03-01"      # reference day for "recent development"
IVF_NPROBE = 3            # lists probed in the label-centroid inverted-file query
SECTION_SEP = "\n"        # documents have no blank lines; sections are lines
MODEL_NAME = "term-count-v1"
HASHED_DIM = 256          # dimensions of the built-in encoder
