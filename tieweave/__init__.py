"""tieweave: find out how tables relate, as Spark jobs.

The package profiles every column of a catalogue, pairs columns that may hold the
same thing, measures how far their values overlap and turns that into banded
relationship suggestions.  Every step is a DataFrame transformation.
"""

from tieweave.config import Config
from tieweave.plans.analysis import Analysis, analyse, run_analysis
from tieweave.plans.loading import LoadedGraph, load_tables
from tieweave.sources.catalog import Catalog

__all__ = ["Analysis", "Catalog", "Config", "LoadedGraph", "analyse", "load_tables", "run_analysis"]
