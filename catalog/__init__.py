"""The checked queries: one per operator, each with the SQL that states its result."""
