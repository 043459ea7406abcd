"""What to run: manifests, layered configuration and the order of stages."""
