"""Tables, catalogs and settings."""
