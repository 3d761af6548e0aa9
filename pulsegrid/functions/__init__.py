"""Column functions shared by the operators."""

from pulsegrid.functions.scalar import *  # noqa: F401,F403
