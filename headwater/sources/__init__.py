"""headwater.sources"""
