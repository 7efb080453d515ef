"""harborlane: set-oriented Spark jobs for multi-tenant ingestion operations.

Every operator is a plain ``DataFrame -> DataFrame`` function. Instants are held as
``timestamp_ntz`` columns in UTC, so no result depends on the session time zone, and the
current time is always a parameter, so every result can be repeated.
"""
