"""Sources, views, state tables and document formats."""
