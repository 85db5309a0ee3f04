"""wavefold: seismic wave-field analytics as Spark tables, plans and array expressions."""
