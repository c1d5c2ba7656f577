"""The operators bound to the shared star-schema tables, with matching SQL."""
