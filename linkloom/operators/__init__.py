"""Link-analysis operators over graph tables."""
