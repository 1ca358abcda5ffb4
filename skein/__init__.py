"""skein: corpus analytics on the DataFrame API."""
