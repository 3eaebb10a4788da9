"""Fixed values. Results depend on them; change none without a reason."""

# Annealing: first and last temperature of the neighbourhood kernel.
T_MIN = 1.0
T_MAX = 10.0
# Kernel exponent: exp(-KERNEL_RATE * grid distance / temperature).
KERNEL_RATE = 0.5
# Initial cell variance is 1 / (VARIANCE_SHARE * number of cells).
VARIANCE_SHARE = 4
# Bernoulli noise is kept inside [EPSILON_FLOOR, EPSILON_CEILING].
EPSILON_FLOOR = 1e-30
EPSILON_CEILING = 1.0 - 1e-16
# Cell variance used in a density is at least this (ours: a cell that has shrunk
# onto one point keeps a finite density instead of failing).
VARIANCE_FLOOR = 1e-12
# Integer-to-bits encoding: value * BITS_STEP, jitter in [-JITTER, JITTER], width.
BITS_STEP = 20
BITS_JITTER = 7
BITS_WIDTH = 20
# Default training job.
DEFAULT_ROWS = 5
DEFAULT_COLS = 5
DEFAULT_MAX_ITER = 10
JOB_MAX_ITER = 50
# Names of the reported index values, in report order.
INTERNAL_REPORT = ("Silhouette", "Davies Bouldin")
EXTERNAL_REPORT = (
    "Czekanowski Dice",
    "Folkes Mallows",
    "NMI",
    "Precision",
    "Recall",
    "Rand",
)
# File stems of one stored iteration in the text layout.
GRID_STEMS = {"prob-": "prob", "items-": "num_items", "epsilon": "bin_epsilon"}
CENTROID_STEMS = {"contCentroid": "cont_mean", "binCentroid": "bin_mean"}
LABEL_STEM = "labels-"

# Size bounds of this build (ours, not results): values held on the driver or
# sent to every task, bytes of a stored block of rows, tasks a core.
MAX_MODEL_VALUES = 4_000_000
MAX_BROADCAST_VALUES = 4_000_000
BLOCK_BYTES = 1 << 25
TASKS_PER_CORE = 64
