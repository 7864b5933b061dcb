"""Training-data operators: media, URL, search, token, mixing, sharding and de-duplication stages."""
