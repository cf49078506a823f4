"""tidewater: a Spark-native sales analytics engine.

Raw order-line and warehouse-sales exports are loaded into typed raw
tables, consolidated into customer, product and sales tables, and
queried through a catalogue of parameterised DataFrame queries, insight
reports, search documents and Structured Streaming jobs.  Every operator
is a lazy DataFrame transformation; Catalyst plans the work.
"""

from tidewater.session import get_session, checkpoint_dir  # noqa: F401

__all__ = ["get_session", "checkpoint_dir"]
