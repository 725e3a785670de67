"""Queries by name."""

from . import chemistry as chemistry
from . import extended as extended
from . import landscapes as landscapes
from . import modelling as modelling
from . import patterns as patterns
from . import assessments as assessments  # after extended, whose SQL it extends
