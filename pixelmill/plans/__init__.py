from pixelmill.plans.registry import REGISTRY  # noqa: F401
from pixelmill.plans import metrics, recode, losses, stats, windows, mixing, blobs, compare, cloud, gates, sources  # noqa: F401
