"""scanlake: Spark operators for microscope scan data held as tables and streams."""
