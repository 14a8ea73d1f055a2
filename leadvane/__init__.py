"""Lead value analytics on Spark: plain ``DataFrame -> DataFrame`` functions over leads, CRM events and companies."""
