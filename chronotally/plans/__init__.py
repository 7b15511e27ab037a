"""The statement language, the engine and registered queries."""
