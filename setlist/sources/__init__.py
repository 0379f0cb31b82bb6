"""Where catalogue tables and payloads come from."""
