"""Sources of fact tables: fact JSON, source text, and a projection of star-schema tables."""
