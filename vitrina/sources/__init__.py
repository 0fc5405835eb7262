"""Fixed schemas, shop tables over the driver data, file sources and sinks."""
