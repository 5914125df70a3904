"""Tables, feature tables, reports and models on storage."""
