"""Registered queries: inputs rendered from the driver tables, run through the
library, each with an independent SQL formulation where SQL can express it."""
