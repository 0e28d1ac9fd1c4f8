"""pricewren: retail-leaflet offer analytics as lazy PySpark DataFrame operators."""
