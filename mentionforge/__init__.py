"""Clinical-mention analytics on PySpark: mentions, concepts, co-occurrence, embeddings, pairs and their scores."""

from .config import Linking, Pipeline
from .operators.linking import link, link_folder
from .plans.pipeline import Run, from_lines, from_mentions

__all__ = ["Linking", "Pipeline", "Run", "from_lines", "from_mentions", "link", "link_folder"]
